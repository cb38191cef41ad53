"""The stemmer's published cases, and METEOR's alignment against all alignments."""

from itertools import product

import numpy as np
import pytest

from lanternfish.functions.stems import measure, stem
from lanternfish.operators import meteor, metrics

# Words and stems of the paper, in its order.
CASES = """caresses caress ponies poni ties ti caress caress cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing conflated conflat troubled troubl sized size
hopping hop tanned tan falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky relational relat conditional condit rational ration valenci valenc hesitanci hesit digitizer digit
conformabli conform radicalli radic differentli differ vileli vile analogousli analog vietnamization vietnam predication predic operator oper feudalism feudal decisiveness decis hopefulness hope callousness callous
formaliti formal sensitiviti sensit sensibiliti sensibl triplicate triplic formative form formalize formal electriciti electr electrical electr hopeful hope goodness good revival reviv allowance allow inference infer
airliner airlin gyroscopic gyroscop adjustable adjust defensible defens irritant irrit replacement replac adjustment adjust dependent depend adoption adopt homologou homolog communism commun activate activ angulariti angular
homologous homolog effective effect bowdlerize bowdler probate probat rate rate cease ceas controll control roll roll generalizations gener oscillators oscil""".split()


def test_stems():
    assert [(w, stem(w)) for w in CASES[::2]] == list(zip(CASES[::2], CASES[1::2]))
    assert [measure(w) for w in "tr ee tree y by trouble oats trees ivy troubles private oaten orrery".split()] == [0, 0, 0, 0, 0, 1, 1, 1, 1, 2, 2, 2, 2]
    assert [stem(w) for w in ("", "a", "as", "über", "x1ing", "is")] == ["", "a", "as", "über", "x1ing", "is"]


def every(candidate, reference):
    """(exact matches, matches, chunks) of the best of all alignments."""
    best = None
    ways = [[None, *[j for j, r in enumerate(reference) if stem(r) == stem(w)]] for w in candidate]
    for places in product(*ways):
        used = [j for j in places if j is not None]
        if len(set(used)) < len(used):
            continue
        exact = sum(j is not None and reference[j] == w for w, j in zip(candidate, places))
        chunks = sum(j is not None and (i == 0 or places[i - 1] is None or places[i - 1] + 1 != j) for i, j in enumerate(places))
        key = (-exact, -len(used), chunks)
        best = key if best is None or key < best else best
    return -best[1], best[2]


@pytest.mark.parametrize("words", [["a", "b"], ["walk", "walks", "walked"], ["walk", "walks", "run", "runs", "the"], ["the", "of", "cat", "cats", "sat", "mat"]])
def test_against_all_alignments(words):
    rng = np.random.default_rng(len(words))
    for _ in range(120):
        candidate, reference = ([str(w) for w in rng.choice(words, rng.integers(0, 6))] for _ in "cr")
        assert meteor.alignment(candidate, reference) == every(candidate, reference), (candidate, reference)


def test_scores():
    say = str.split
    assert meteor.alignment(say("the cat sat on the mat"), say("on the mat sat the cat")) == (6, 3)
    assert metrics.meteor_exact_of(say("the cat sat"), [say("the cat sat")]) == pytest.approx(1 - 0.5 / 27)
    assert metrics.meteor_exact_of(say("dogs running"), [say("cats"), say("the dog runs")]) > 0.4
    assert metrics.meteor_exact_of([], [say("a")]) == metrics.meteor_exact_of(say("a"), []) == 0.0
    # a greedy choice of the nearest "the" would break the run
    assert meteor.alignment(say("the big cat saw the small dog"), say("the small dog the big cat")) == (6, 2)
    long = [f"w{i % 50}" for i in range(3000)]
    assert meteor.alignment(long, long) == (3000, 1)  # words of many places

"""Licence names and spans that near texts and repeated notices put to the test."""

import re

import numpy as np
import pytest

from lanternfish.llm import licences
from lanternfish.llm.decontaminate import words_of

INDEX = licences.Index(licences.TEMPLATES)
TEXTS = {n: t for n, t in licences.TEMPLATES if len(t.split()) > 1000}


def spans(text: str) -> list[tuple[str, int, int, float]]:
    return INDEX.spans(np.array([INDEX.vocab.get(w, 0) for w in words_of(text.encode())], dtype=np.int64))


def names(text: str) -> list[str]:
    return [s[0] for s in spans(text)]


@pytest.mark.parametrize("licence", ["BSD-2-Clause", "BSD-3-Clause", "MIT", "ISC"])
def test_short_texts_are_told_apart(licence):
    text = max((t for n, t in licences.TEMPLATES if n == licence), key=len)
    found = spans(f"Copyright 2020 someone {text} the end")
    assert [(s[0], s[2] - s[1], s[3]) for s in found] == [(licence, len(words_of(text.encode())), 1.0)]
    assert names(re.sub("copyright holders?", "regents", text, flags=re.I)) == [licence]


@pytest.mark.parametrize("licence", sorted(TEXTS))
def test_whole_texts(licence):
    lines = TEXTS[licence].splitlines()
    lines[len(lines) // 2] = "another line of words"
    assert names("intro " + "\n".join(lines) + " outro")[0] == licence and len(spans(TEXTS[licence])) == 1


def test_versions_are_told_apart():
    said = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version."
    assert names(said.format(2)) == ["GPL-2.0-or-later"] and names(said.format(3)) == ["GPL-3.0-or-later"] and names(said.format(7)) == []
    lesser = said.replace("program", "library").replace("GNU", "GNU Lesser")
    assert names(lesser.format("2.1")) == ["LGPL-2.1-or-later"] and names(lesser.format(3)) == ["LGPL-3.0-or-later"]
    assert names("This work is licensed under the GNU General Public License, version 2.") == ["GPL-2.0"]
    assert names("Licensed under CC BY-NC-SA 3.0.") == ["CC-BY-NC-SA-3.0"] and names("Licensed under CC BY 2.0.") == ["CC-BY-2.0"]


def test_parts_of_texts_are_found():
    assert names(licences.MIT_GRANT) == ["MIT"] and names(licences.BSD_FIRST) == ["BSD-2-Clause OR BSD-3-Clause"]


@pytest.mark.parametrize("notice", ["Released under the MIT License.", "Licensed under CC BY 4.0.", "Licensed under CC BY-NC 4.0."])
@pytest.mark.parametrize("between", ["\n", " and ", "\nsome more words\n"])
def test_repeated_short_notices(notice, between):
    for n in (1, 2, 3, 10):
        found = spans(between.join([notice] * n))
        step, size = len(words_of((notice + between).encode())), len(words_of(notice.encode()))
        assert [(a, b, c) for _, a, b, c in found] == [(i * step, i * step + size, 1.0) for i in range(n)]


def test_edited_copies_of_a_short_notice():
    whole, edited = "Licensed under CC BY 4.0.", "Licenced under CC BY 4.0."
    for said in ([edited] * 4, [whole, edited], [edited, whole, edited], [whole, edited, whole, edited, edited]):
        assert [round(c, 3) for *_, c in spans("\n".join(said))] == [1.0 if s == whole else 0.833 for s in said]


SMALL = [("A", " ".join(f"a{i}" for i in range(12))), ("B", " ".join(f"b{i}" for i in range(30))), ("C", " ".join([f"a{i}" for i in range(6)] + [f"c{i}" for i in range(10)])), ("D", "d0 d1 d0 d1 d2 d0 d1 d3")]


def plain_winnow(h):
    if not h:
        return []
    w = min(licences.WINDOW, len(h))
    return sorted({max(i for i in range(lo, lo + w) if h[i] == min(h[lo : lo + w])) for lo in range(len(h) - w + 1)})


def test_winnowing_against_a_plain_version():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 10, 200):
        h = rng.integers(0, 8, n).astype(np.uint64)
        assert licences.winnow(h).tolist() == plain_winnow(h.tolist())


def plain_align(template, text):
    """(places of matched words, words between) of the best alignment to the whole text, without a band: each matched word counts 1, and
    each word between 1 / room less."""
    n, m, cost = len(template), len(text), 1 / licences.room(len(template))
    score, step = [[0.0] * (m + 1) for _ in range(n + 1)], [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(1, n + 1):
        for j in range(m + 1):
            best, way = score[i - 1][j], 1
            if j and text[j - 1] == template[i - 1] and score[i - 1][j - 1] + 1 >= best:
                best, way = score[i - 1][j - 1] + 1, 2
            if j and score[i][j - 1] - cost > best + 1e-9:
                best, way = score[i][j - 1] - cost, 3
            score[i][j], step[i][j] = best, way if best > 1e-9 else 0
    i, j = n, max(range(m + 1), key=lambda j: score[n][j])
    at, between = [], []
    while i and step[i][j]:
        if step[i][j] == 3:
            between.append(j - 1)
            j -= 1
            continue
        if step[i][j] == 2:
            at.append(j - 1)
            j -= 1
        i -= 1
    return at[::-1], between


def plain_spans(index, ids):
    """Every template aligned to the whole text, the best taken, its words blanked, and so on."""
    ids, kept = ids.copy(), []
    while True:
        best = None
        for k, template in enumerate(index.ids):
            at, between = plain_align(template.tolist(), ids.tolist())
            c = len(at) / (len(template) + len(between) / 4)
            if at and c >= licences.COVERAGE - 1e-9 and all(at[-1] < g[1] or at[0] >= g[2] for g in kept):
                key = (-len(at), -c, at[0], k)
                if best is None or key < best[0]:
                    best = key, (index.names[k], at[0], at[-1] + 1, c)
        if best is None:
            return sorted(kept)
        kept.append(best[1])
        ids[best[1][1] : best[1][2]] = 0


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        i, what = int(rng.integers(0, len(words))), rng.integers(0, 3)
        if what == 0:
            words[i] = "x"
        elif what == 1:
            words.insert(i, "y")
        elif len(words) > 1:
            del words[i]
    return words


def test_alignment_along_a_chain():
    """Along any chain of shared runs the alignment is as good as one without a band, also where many words were put in."""
    rng = np.random.default_rng(3)
    index = licences.Index(SMALL)
    for trial in range(150):
        k = int(rng.integers(0, 4))
        words = edited(rng, SMALL[k][1].split(), int(rng.integers(0, 4)))
        at = int(rng.integers(0, len(words) + 1))
        words = ["z"] * int(rng.integers(0, 4)) + words[:at] + ["y"] * int(rng.integers(0, 12)) + words[at:] + ["z"] * 3
        ids = np.array([index.vocab.get(w.encode(), 0) for w in words], dtype=np.int64)
        i, p = index.chain(k, licences.gram_hashes(ids), 0)
        assert (np.diff(i) > 0).all() and (np.diff(p) > 0).all()
        if len(i):
            found, between = licences.align(index.ids[k], ids, i, p)
            best, others = plain_align(index.ids[k].tolist(), ids.tolist())
            cost = 1 / licences.room(len(index.ids[k]))
            assert abs(len(found) - cost * len(between) - len(best) + cost * len(others)) < 1e-9


@pytest.mark.parametrize("licence", ["BSD-2-Clause", "BSD-3-Clause", "MIT", "ISC"])
@pytest.mark.parametrize("size", [1, 2, 7, 12, 25, 50])
def test_inserted_words(licence, size):
    """Words put into a licence at any place leave its name and its whole span."""
    words = max((t for n, t in licences.TEMPLATES if n == licence), key=len).split()
    for at in range(1, len(words), 1 if size == 12 else 5):
        said = " ".join(words[:at] + ["foreign"] * size + words[at:])
        (name, a, b, share), *more = spans(f"Some words before {said} and words after")
        assert (name, more) == (licence, []) and b - a == len(words_of(said.encode())) and (share < 1 or size == 0)


def test_a_second_copyright_line():
    text = max((t for n, t in licences.TEMPLATES if n == "MIT"), key=len)
    half = text.index("The above copyright notice")
    assert names(text[:half] + "Copyright (c) 2011-2020 The Authors of Some Project and Others. All rights reserved. " + text[half:]) == ["MIT"]


def test_names_that_a_word_changes():
    """A licence whose name holds another word throughout is that other licence."""
    told = re.sub("GNU General Public License", "GNU Affero General Public License", TEXTS["GPL-3.0"])
    assert "GPL-3.0" not in names(told) and names(told)[0] == "AGPL-3.0"
    assert names(TEXTS["AGPL-3.0"]) == ["AGPL-3.0"] and names(TEXTS["GPL-3.0"]) == ["GPL-3.0"]
    notice = dict(licences.TEMPLATES)["GPL-3.0-or-later"]
    assert names(notice) == ["GPL-3.0-or-later"] and "GPL-3.0-or-later" not in names(notice.replace("GNU General", "GNU Affero General"))
    assert names("Licensed under CC BY-NC-SA 4.0 and so on") == ["CC-BY-NC-SA-4.0"]


def test_spans_against_aligning_everywhere():
    """Edited notices in a text: the fingerprints miss none that keeps a run of five words, which each of these does."""
    rng = np.random.default_rng(5)
    index = licences.Index(SMALL)
    found = 0
    for trial in range(25):
        words = []
        for _ in range(int(rng.integers(1, 4))):
            words += ["z"] * int(rng.integers(0, 12)) + edited(rng, SMALL[int(rng.integers(0, 3))][1].split(), int(rng.integers(0, 2)))
        ids = np.array([index.vocab.get(w.encode(), 0) for w in words], dtype=np.int64)
        got, want = index.spans(ids), plain_spans(index, ids)
        assert [(n, round(c * 100)) for n, *_, c in got] == [(n, round(c * 100)) for n, *_, c in want]
        assert all(min(g[2], w[2]) - max(g[1], w[1]) >= 0.8 * (w[2] - w[1]) for g, w in zip(got, want))
        found += len(want)
    assert found > 30

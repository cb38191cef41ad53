"""Porter's stemmer (Porter, 1980), as rules: a word loses the longest ending that a step lists, if what is left meets its condition."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

# The endings of steps 2, 3 and 4 and what they turn into, as the paper lists them.
STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
         "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = {e: "" for e in ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")}


def kinds(word: str) -> str:
    """A letter for each of the word's: v for a vowel, c for a consonant; y is a vowel after a consonant."""
    out = ""
    for i, letter in enumerate(word):
        out += "v" if letter in "aeiou" or letter == "y" and i and out[-1] == "c" else "c"
    return out


def measure(stem: str) -> int:
    """How often vowels are followed by consonants."""
    return kinds(stem).count("vc")


def _doubled(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and kinds(word)[-1] == "c"


def _short(word: str) -> bool:
    """Whether it ends in consonant, vowel, consonant, the last being none of w, x, y."""
    return kinds(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _replaced(word: str, endings: dict[str, str], allowed: Callable[[str, str], bool]) -> str:
    for size in range(min(7, len(word)), 0, -1):
        if (end := word[-size:]) in endings:
            stem = word[:-size]
            return stem + endings[end] if allowed(stem, end) else word
    return word


@lru_cache(1 << 16)
def stem(word: str) -> str:
    """The stem of a word in lower case; words of one or two letters, and others than a-z, stay as they are."""
    if len(word) < 3 or not (word.isascii() and word.isalpha()):
        return word
    # plurals
    word = _replaced(word, {"sses": "ss", "ies": "i", "ss": "ss", "s": ""}, lambda *_: True)
    # past and progressive
    if word.endswith("eed"):
        word = word[:-1] if measure(word[:-3]) > 0 else word
    else:
        for end in ("ed", "ing"):
            if word.endswith(end) and "v" in kinds(word[: -len(end)]):
                word = word[: -len(end)]
                if word.endswith(("at", "bl", "iz")):
                    word += "e"
                elif _doubled(word) and word[-1] not in "lsz":
                    word = word[:-1]
                elif measure(word) == 1 and _short(word):
                    word += "e"
                break
    if word.endswith("y") and "v" in kinds(word[:-1]):
        word = word[:-1] + "i"
    word = _replaced(word, STEP2, lambda s, _: measure(s) > 0)
    word = _replaced(word, STEP3, lambda s, _: measure(s) > 0)
    word = _replaced(word, STEP4, lambda s, end: measure(s) > 1 and (end != "ion" or s[-1:] in ("s", "t")))
    # a last e, and a last double l
    if word.endswith("e") and (measure(word[:-1]) > 1 or measure(word[:-1]) == 1 and not _short(word[:-1])):
        word = word[:-1]
    return word[:-1] if measure(word) > 1 and _doubled(word) and word[-1] == "l" else word

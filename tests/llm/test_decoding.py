"""Decodings of SentencePiece units and of long texts are held against the library."""

import hashlib

import pytest

from lanternfish.llm import queries, sentencepiece_bpe


class Other:
    """The library, but for one text that it decodes otherwise."""

    def __init__(self, library, odd):
        self.library, self.odd = library, odd

    def __getattr__(self, name):
        return getattr(self.library, name)

    def decode(self, ids):
        out = self.library.decode(ids)
        return [t.replace(self.odd, "?") for t in out] if isinstance(out, list) else out.replace(self.odd, "?")


def vocabulary():
    return sentencepiece_bpe.Vocabulary(sentencepiece_bpe.read_model(queries.model_path()))


def test_units_decodings_are_checked():
    v = vocabulary()
    v.library = Other(v.library, "zebra")
    with pytest.raises(ValueError, match="decodes"):
        v.learn({"▁zebra", "▁horse"})


def test_long_texts_are_checked():
    v = vocabulary()
    v.library = Other(v.library, "grey horse")
    v.digest_all(["a short text", "a grey horse"])
    with pytest.raises(ValueError, match="another way"):
        v.digest_all(["short", "a long grey horse"], check_chars=10)


def test_one_text_of_some_or_all_are_checked():
    texts = [f"text {i}" if i % 3 else "" for i in range(13)] + [""]
    for every, seen in ((1, 9), (4, 3)):
        v = vocabulary()
        called = []
        v.library = type("Counted", (Other,), {"encode": lambda self, x, **k: called.append(x) or self.library.encode(x, **k)})(v.library, "zebra")
        v.digest_all(texts, every)
        v.digest_all(["another text"], every)
        assert sum(x in [*texts, "another text"] for x in called if isinstance(x, str)) == seen


def test_units_of_any_length(monkeypatch):
    """A text of five million letters without a space against the library, in bounded memory; runs of unlike letters too."""
    import resource

    v = vocabulary()
    rng = __import__("random").Random(3)
    letters = "".join(rng.choices("etaoinshrdlu", k=1_000_000)) * 5
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    (n, ids, back), = v.digest_all([letters])
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 2_500_000  # kilobytes, the library's own included
    want = v.library.encode(letters, add_eos=True)
    assert n == len(want) and ids == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
    assert back == hashlib.sha256(letters.encode()).hexdigest()
    assert not v.known or max(map(len, v.known)) <= sentencepiece_bpe.LONGEST
    for size in (49, 200, 3000):
        text = "".join(rng.choices("abcdeé日本語ñÄz", k=size))
        assert v._merge_long(list(text)) == v._merge_short(list(text))


def test_what_is_remembered_is_bounded(monkeypatch):
    monkeypatch.setattr(sentencepiece_bpe, "REMEMBERED_BYTES", 20_000)
    v = vocabulary()
    for k in range(40):
        texts = [f"word{chr(97 + (i * 7 + k) % 26)}{chr(97 + i % 26)}x{'ab' * (i % 9)}" for i in range(60)] + ["common words here"]
        assert [r[0] for r in v.digest_all(texts)] == [len(v.library.encode(t, add_eos=True)) for t in texts]
        assert v.held < 20_000 + 70 * 1000 and len(v.known) + len(v.older) < 400


def test_what_is_hashed_is_the_decoding_of_the_ids():
    v = vocabulary()
    texts = ["two  words", " ▁ \n\t", "été 日本 \U0001f600́ x²", "a\n b\nc", "word " * 50_000, "\n"]
    for text, (n, _, digest) in zip(texts, v.digest_all(texts)):
        ids = v.library.encode(text, add_eos=True)
        assert n == len(ids) and digest == hashlib.sha256(v.library.decode(ids).encode()).hexdigest()
    v.known["▁▁words"] = (v.known["▁▁words"][0], "  other")
    with pytest.raises(ValueError, match="another way"):
        v.digest_all(["two  words"], 1)

"""SentencePiece encoding and decoding for merge-type vocabularies, with a score-ordered agenda."""

from __future__ import annotations

import hashlib
import heapq
import math
import re
from array import array
from collections.abc import Iterator
from itertools import islice
from operator import add

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanternfish.llm.batches import released, text_blocks

SPACE = "▁"
FINE = re.compile(f"[\\n\\t\\d]|{SPACE}*[^\\W\\d_²³¹¼½¾]+|{SPACE}*(?:[^\\w{SPACE}\\n\\t]|[_²³¹¼½¾])+|{SPACE}+")
WHOLE = re.compile("(?s).+")
#: Bytes of the units of a generation that a worker remembers with their encodings, and one generation more; longer
#: units than these characters are encoded each time they are met. Speed and memory only.
REMEMBERED_BYTES, LONGEST = 96 << 20, 64
#: Bytes of text, in whole texts, whose units are held at once. Memory only.
SLICE_BYTES = 1 << 20
#: One text of so many is held against the library as a whole, beside every unit of every text; 1 holds all.
CHECK_EVERY, CHECK_CHARS = 8, 100_000
#: Up to so many characters a list serves as agenda.
SHORT = 48
RESULT = "n_tokens bigint, ids_sha256 string, decoded_sha256 string"


class Vocabulary:
    """A merge-type (BPE) model with identity normalisation, as bytes of its file."""

    def __init__(self, model: bytes):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        proto.ParseFromString(model)
        norm, kinds = proto.normalizer_spec, {p.type for p in proto.pieces}
        if proto.trainer_spec.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or not norm.add_dummy_prefix or proto.trainer_spec.treat_whitespace_as_suffix or kinds & {4, 5} or len(proto.denormalizer_spec.precompiled_charsmap):
            raise ValueError("only merge-type models with identity normalisation and no user-defined or unused pieces")
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.piece = [p.piece for p in proto.pieces]
        self.kind = [p.type for p in proto.pieces]
        self.merged = {p.piece: (i, p.score) for i, p in enumerate(proto.pieces) if p.type == 1}
        self.number = {p: i for p, (i, _) in self.merged.items()}
        self.cost = {p: -score for p, (_, score) in self.merged.items()}
        self.plain = [p.replace(SPACE, " ") if k == 1 else None for p, k in zip(self.piece, self.kind)]
        self.byte = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == 6}
        self.unknown, self.end = self.library.unk_id(), self.library.eos_id()
        #: Merges never reach over a boundary: before a run of spaces, between a letter and what is none,
        #: around a digit, a tab or a line end. That holds if no piece has a boundary inside.
        self.units = FINE if all(len(FINE.findall(p)) == 1 for p in self.merged) else WHOLE
        #: ids of a unit, joined by spaces, and their decoding, learnt in this and in the generation before
        self.known: dict[str, tuple[str, str]] = {}
        self.older: dict[str, tuple[str, str]] = {}
        self.held = 0  # bytes of the first of these
        #: places of the costs in their order; pieces of one cost have one place
        self.place = {c: i for i, c in enumerate(sorted(set(self.cost.values())))}
        self.texts = 0  # texts met so far

    def merge(self, unit: str) -> list[int]:
        """Ids of ``unit``: of all adjacent pairs of symbols that make a piece, the best score merges first,
        of equals the leftmost. The agenda of a short unit is a list by place, else a heap in which
        entries whose symbols have changed are passed over."""
        symbols = self._merge_short(list(unit)) if len(unit) <= SHORT else self._merge_long(list(unit))
        ids = [self.number.get(s) for s in symbols]
        if None not in ids:
            return ids
        ids = []
        for s in symbols:
            if s in self.number:
                ids.append(self.number[s])
            elif self.byte:
                ids += [self.byte[b] for b in s.encode()]
            else:
                ids.append(self.unknown)
        return ids

    def _merge_short(self, symbols: list[str]) -> list[str]:
        get, never = self.cost.get, math.inf
        agenda = [get(pair, never) for pair in map(add, symbols, symbols[1:])]
        while agenda and (best := min(agenda)) != never:
            i = agenda.index(best)
            symbols[i] = here = symbols[i] + symbols.pop(i + 1)
            del agenda[i]
            if i < len(agenda):
                agenda[i] = get(here + symbols[i + 1], never)
            if i:
                agenda[i - 1] = get(symbols[i - 1] + here, never)
        return symbols

    def _merge_long(self, symbols: list[str]) -> list[str]:
        """The agenda holds numbers, the place of a pair's cost and then that of its left symbol, 8 bytes and an
        integer each, so a unit of millions of characters fits."""
        n = len(symbols)
        before, after = array("q", range(-1, n - 1)), array("q", [*range(1, n), -1])
        get, place = self.cost.get, self.place
        agenda = [place[c] << 40 | i for i, c in enumerate(map(get, map(add, symbols, islice(symbols, 1, None)))) if c is not None]
        heapq.heapify(agenda)
        while agenda:
            best = heapq.heappop(agenda)
            left = best & (1 << 40) - 1
            right = after[left]
            if right < 0 or not symbols[left]:
                continue
            here = symbols[left] + symbols[right]
            cost = get(here)
            if cost is None or place[cost] != best >> 40:  # its symbols have changed
                continue
            symbols[left], symbols[right] = here, ""
            after[left] = far = after[right]
            if far >= 0:
                before[far] = left
                if (c := get(here + symbols[far])) is not None:
                    heapq.heappush(agenda, place[c] << 40 | left)
            near = before[left]
            if near >= 0 and (c := get(symbols[near] + here)) is not None:
                heapq.heappush(agenda, place[c] << 40 | near)
        return [s for s in symbols if s]

    def decode(self, ids: list[int]) -> str:
        """Text of ``ids``, with the space that encoding puts first; bytes that are no UTF-8 become U+FFFD each."""
        texts = [self.plain[i] for i in ids]
        if None not in texts:
            return "".join(texts)
        out, held = [], bytearray()
        for i in [*ids, None]:
            if i is not None and self.kind[i] == 6:
                held.append(int(self.piece[i][3:5], 16))
                continue
            while held:
                try:
                    out.append(held.decode())
                    break
                except UnicodeDecodeError as e:
                    out.append(held[: e.start].decode() + "�")
                    del held[: e.start + 1]
            held = bytearray()
            if i is not None and self.kind[i] != 3:
                out.append(" ⁇ " if self.kind[i] == 2 else self.piece[i].replace(SPACE, " "))
        return "".join(out)

    def split(self, text: str) -> list[str]:
        return self.units.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def learn(self, units: set[str]) -> dict[str, tuple[str, str]]:
        """Encode and decode units not yet known, and hold both against the library in one call each. Returns
        what is not remembered, as it is too long."""
        if self.held > REMEMBERED_BYTES:
            self.older, self.known, self.held = self.known, {}, 0
        missing = units - self.known.keys()
        again = {u: self.older[u] for u in missing & self.older.keys()}
        new = list(missing - again.keys())
        ids = [self.merge(u) for u in new]
        back = list(map(self.decode, ids))
        if new and not self._agrees(new, ids, back):
            self._blame(new, ids, back)
        learnt = dict(zip(new, zip([" ".join(map(str, own)) for own in ids], back)))
        long = {u: learnt.pop(u) for u in new if len(u) > LONGEST}
        for made in (again, learnt):
            self.known.update(made)
            self.held += sum(300 + 4 * len(u) + len(i) + 4 * len(t) for u, (i, t) in made.items())
        return long

    def _agrees(self, units: list[str], ids: list[list[int]], back: list[str]) -> bool:
        """Whether the library encodes the units as ``ids`` and decodes these as ``back``: all in one text, each after a
        line end, which never merges with anything if units end there."""
        if self.units is WHOLE:
            return False
        first, two = self.library.encode("\n"), self.library.encode("\n\n")
        end, want = two[len(first) :], list(first)
        for own in ids:
            want += own
            want += end
        text = "\n" + "\n".join(units).replace(SPACE, " ") + "\n"
        return self.library.encode(text) == want and self.library.decode(want) == "\n" + "\n".join(back) + "\n"

    def _blame(self, units: list[str], ids: list[list[int]], back: list[str]) -> None:
        """Raise for the first unit that the library encodes or decodes otherwise, if there is one."""
        # a space comes first by itself; what has none follows a line end
        theirs = self.library.encode([u[1:] if u[0] == SPACE else "\n" + u for u in units], num_threads=1)
        end = self.library.encode("\n")
        if wrong := [(u, a, b) for u, a, b in zip(units, ids, theirs) if a != b and a != b[len(end) * (u[0] != SPACE) :] and u != SPACE]:
            raise ValueError(f"the library encodes {wrong[0][0]!r} as {wrong[0][2]}, not {wrong[0][1]}")
        # the library passes over a space that comes first; a line end before the ids keeps it
        theirs, first = self.library.decode([end + own for own in ids]), self.library.decode(end)
        if wrong := [(u, a, b) for u, a, b in zip(units, back, theirs) if first + a != b]:
            raise ValueError(f"the library decodes the ids of {wrong[0][0]!r} as {wrong[0][2]!r}, not {wrong[0][1]!r}")
        if self.units is not WHOLE:
            raise ValueError("the library encodes or decodes units in another way where they follow each other")

    def encode(self, text: str) -> list[int]:
        """All ids, the end id included, by the agenda only."""
        return [i for u in self.split(text) for i in self.merge(u)] + [self.end]

    def digest_all(self, texts: list[str], check_every: int = CHECK_EVERY, check_chars: int = CHECK_CHARS) -> list[tuple[int, str, str]]:
        """(n_tokens, ids_sha256, decoded_sha256) of each text. Units and their decodings are looked up, new ones are
        learnt first, which holds each against the library. The first of ``check_every`` texts that a worker
        meets, and each of more than ``check_chars`` characters, is also held against the library as a whole."""
        split = list(map(self.split, texts))
        long = self.learn(set().union(*split))
        known, rows = self.known, []
        for text, units in zip(texts, split):
            learnt = [known.get(u) or long[u] for u in units] if long else [known[u] for u in units]
            ids = " ".join([*[i for i, _ in learnt], str(self.end)])
            back = "".join([t for _, t in learnt]).removeprefix(" ")
            if text and (self.texts % check_every == 0 or len(text) > check_chars):
                lib = self.library.encode(text, add_eos=True)
                if " ".join(map(str, lib)) != ids or self.library.decode(lib) != back:
                    raise ValueError("the library encodes or decodes a text in another way")
            self.texts += bool(text)
            rows.append((ids.count(" ") + 1, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
        return rows


_VOCABULARIES: dict[str, Vocabulary] = {}


def vocabulary(model: bytes) -> Vocabulary:
    """One for each worker process."""
    key = hashlib.sha256(model).hexdigest()
    if key not in _VOCABULARIES:
        _VOCABULARIES[key] = Vocabulary(model)
    return _VOCABULARIES[key]


def read_model(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def token_digests(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", check_every: int = CHECK_EVERY) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of each row: ids with an end id, joined by spaces.

    The model's file is read on the driver and travels with the task. Every unit of every text is held against
    the sentencepiece library, and one whole text of ``check_every``; a difference is an error. A null text is
    an empty one, which has the end id only. Repeated rows give equal results, and so do ties, as there are none:
    equal scores merge from the left. Very long texts are one agenda a unit; texts are held a megabyte, or one text,
    at a time. Columns other than the two are not read, whatever they are called. An empty table gives an
    empty result.
    """
    model = read_model(model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(model)
        for batch, texts in text_blocks(batches, 1, SLICE_BYTES):
            columns = list(zip(*vocab.digest_all([t.decode() for t in texts], check_every))) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.string(), pa.string())))],
                                             names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])
        vocab.older = {}  # what the task's last units didn't need

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col).alias("__text")).mapInArrow(released(run), f"`{id_col}` {kind}, {RESULT}")


def token_ids(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>, decoded) of each row, for use beside :func:`token_digests`; its cases are the same."""
    model = read_model(model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(model)
        for batch, texts in text_blocks(batches, 1, SLICE_BYTES):
            ids = [vocab.encode(t.decode()) for t in texts]
            back = [b[1:] if b[:1] == " " else b for b in map(vocab.decode, ids)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(back, pa.string())], names=[id_col, "ids", "decoded"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col).alias("__text")).mapInArrow(released(run), f"`{id_col}` {kind}, ids array<int>, decoded string")

"""Benchmark decontamination: suffix arrays over shards of the corpus, searched for every test suffix."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanternfish.llm.batches import released, text_blocks
from lanternfish.llm.store import place_of

#: UTF-8 bytes of a word stay (0-9, a-z and all beyond ASCII), A-Z become a-z, the rest becomes a space.
WORD_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
WINDOW = 10
#: Words of test items that a task holds at once; a larger benchmark is searched block by block.
BLOCK_WORDS = 1_000_000
#: Bytes of documents, in whole texts, that make one shard with its suffix array.
SHARD_BYTES = 2 << 20
RESULT = "n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean, longest_match bigint, matches array<struct<item_id:string,item_word:bigint,doc_word:bigint,words:bigint>>"


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


class TestBlock:
    """Test items of at most ``BLOCK_WORDS`` words (one longer item is a block of its own)."""

    __test__ = False

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.names = [name for name, _ in items]
        self.vocab: dict[bytes, int] = {}
        tokens, starts, owner, within, lengths = [], [], [], [], []
        for k, (_, words) in enumerate(items):
            n = min(window, len(words))
            for i in range(len(words) - n + 1) if words else ():
                starts.append(len(tokens) + i)
                owner.append(k)
                within.append(i)
                lengths.append(n)
            tokens += [self.vocab.setdefault(w, len(self.vocab) + 1) for w in words] + [0]
        self.starts, self.owner, self.within, self.lengths = (np.array(x, dtype=np.int64) for x in (starts, owner, within, lengths))
        padded = np.array(tokens + [0] * window, dtype=np.int64)
        self.windows = padded[self.starts[:, None] + np.arange(window)] if len(starts) else np.zeros((0, window), dtype=np.int64)
        self.inside = np.arange(window)[None, :] < self.lengths[:, None]
        self.deepest = max((len(w) for _, w in items), default=1)


def suffix_array(tokens: np.ndarray, depth: int) -> np.ndarray:
    """Starts of all suffixes of ``tokens``, sorted by their first ``depth`` tokens or more, by prefix doubling. A round
    sorts only the suffixes that still tie, each group in its own places."""
    n, k = len(tokens), 1
    order = np.argsort(tokens, kind="stable")
    key, rank, tied = tokens[order], np.empty(n, dtype=np.int64), np.arange(n)
    while n:
        new = np.r_[True, key[1:] != key[:-1]]
        first = np.flatnonzero(new)
        size = np.diff(np.r_[first, len(key)])
        rank[order[tied]] = np.repeat(tied[first], size)
        tied = tied[np.repeat(size > 1, size)]
        if not len(tied) or k >= depth:
            break
        at = order[tied]
        after = np.full(len(at), -1, dtype=np.int64)  # a suffix that has ended comes first
        inside = at + k < n
        after[inside] = rank[at[inside] + k]
        key = rank[at] * (n + 1) + after + 1
        by = np.argsort(key, kind="stable")
        order[tied], key = at[by], key[by]
        k *= 2
    return order


def _bounds(tokens: np.ndarray, order: np.ndarray, windows: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every test suffix, by binary search, the range of ``order`` whose suffixes begin with its window."""
    padded = np.r_[tokens, np.zeros(windows.shape[1], dtype=np.int64)]
    steps, rows = np.arange(windows.shape[1]), np.arange(len(windows))
    out = []
    for right in (False, True):
        lo, hi = np.zeros(len(windows), dtype=np.int64), np.full(len(windows), len(order), dtype=np.int64)
        while (open_ := lo < hi).any():
            mid = (lo + hi) // 2
            seen = padded[order[np.minimum(mid, len(order) - 1)][:, None] + steps]
            differs = (seen != windows) & inside
            first = differs.argmax(axis=1)
            some = differs[rows, first]
            up = np.where(some, seen[rows, first] < windows[rows, first], right)
            lo, hi = np.where(open_ & up, mid + 1, lo), np.where(open_ & ~up, mid, hi)
        out.append(lo)
    return out[0], out[1]


def search_shard(tokens: np.ndarray, block: TestBlock) -> tuple[np.ndarray, np.ndarray]:
    """(position in ``tokens``, index of the test window) of every verbatim occurrence. 0 is no test word.

    All of the shard is in the suffix array; a word that is no test word is like no other. Test suffixes that hold
    a word which the shard lacks have no place in it; each of the others is sought."""
    none = np.array([], dtype=np.int64)
    present = np.zeros(len(block.vocab) + 1, dtype=bool)
    present[tokens] = True
    present[0] = False
    asked = np.flatnonzero((present[block.windows] | ~block.inside).all(axis=1))
    if not len(asked):
        return none, none
    text = np.where(tokens > 0, tokens, len(block.vocab) + 1 + np.arange(len(tokens)))
    order = suffix_array(text, block.deepest)
    lo, hi = _bounds(text, order, block.windows[asked], block.inside[asked])
    n = hi - lo
    which = np.repeat(asked, n)
    at = order[np.repeat(lo - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(int(n.sum()))] if n.sum() else none
    return at, which


def longest_matches(at: np.ndarray, which: np.ndarray, block: TestBlock) -> tuple[np.ndarray, ...]:
    """Occurrences of windows that follow one another in text and item, joined: (item, word in the item,
    position, words) of every verbatim match that can't be extended."""
    item, within, length = block.owner[which], block.within[which], block.lengths[which]
    order = np.lexsort((at, at - within, item))
    item, within, length, at = item[order], within[order], length[order], at[order]
    new = np.r_[True, (item[1:] != item[:-1]) | (at[1:] - within[1:] != at[:-1] - within[:-1]) | (at[1:] != at[:-1] + 1)]
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(at)] - 1
    return item[first], within[first], at[first], at[last] + length[last] - at[first]


def scan_shard(texts: list[bytes], blocks: Iterator[TestBlock]) -> list[tuple]:
    """A row of :data:`RESULT` for each text; the texts make one shard, with one suffix array a block."""
    words = [words_of(t) for t in texts]
    size = np.array([len(w) for w in words], dtype=np.int64)
    start = np.r_[0, np.cumsum(size + 1)[:-1]].astype(np.int64)  # a word that matches nothing after each text
    cover = np.zeros(int((size + 1).sum()) + 1, dtype=np.int64)
    found: dict[int, dict[str, list]] = {}
    for block in blocks:
        tokens = np.zeros(len(cover) - 1, dtype=np.int32)
        for s, n, w in zip(start.tolist(), size.tolist(), words):
            tokens[s : s + n] = np.fromiter(map(block.vocab.get, w, repeat(0)), dtype=np.int32, count=n)
        at, which = search_shard(tokens, block)
        if not len(at):
            continue
        item, within, at, length = longest_matches(at, which, block)
        np.add.at(cover, at, 1)
        np.add.at(cover, at + length, -1)
        doc = np.searchsorted(start, at, "right") - 1
        for d, k, i, p, n in zip(doc.tolist(), item.tolist(), within.tolist(), (at - start[doc]).tolist(), length.tolist()):
            found.setdefault(d, {}).setdefault(block.names[k], []).append((i, p, n))
    hit = np.r_[0, np.cumsum(np.cumsum(cover[:-1]) > 0)]
    rows = []
    for d, (s, n) in enumerate(zip(start.tolist(), size.tolist())):
        by_item = found.get(d, {})
        names = sorted(by_item)
        matches = [{"item_id": k, "item_word": i, "doc_word": p, "words": m} for k in names for i, p, m in sorted(by_item[k], key=lambda x: (x[1], x[0]))]
        covered = int(hit[s + n] - hit[s])
        rows.append((n, covered, len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), covered > 0, max((m["words"] for m in matches), default=0), matches))
    return rows


def _blocks(bench: DataFrame, id_col: str, text_col: str, window: int, block_words: int) -> Iterator[TestBlock]:
    held, n = [], 0
    for name, text in bench.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col(text_col)).toLocalIterator():
        words = words_of((text or "").encode())
        if held and n + len(words) > block_words:
            yield TestBlock(held, window)
            held, n = [], 0
        held.append((name, words))
        n += len(words)
    if held:
        yield TestBlock(held, window)


def _sent(docs: DataFrame, bench: DataFrame, id_col: str, text_col: str, window: int, block_words: int) -> Callable[[], Iterator[TestBlock]]:
    """A function for tasks that yields the test items' blocks, which are broadcast one by one."""
    context = docs.sparkSession.sparkContext
    held = [context.broadcast(b) for b in _blocks(bench, id_col, text_col, window, block_words)]

    def each() -> Iterator[TestBlock]:
        for b in held:
            yield b.value
            if len(held) > 1:
                b._value = None  # the next use reads it from the executor's disk

    return each


def contamination(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                  item_text_col: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(id, n_words, n_hit, n_items, items_sha256, contaminated, longest_match, matches) of each document.

    A window is ``window`` consecutive words of an item, or all of a shorter one. Some megabytes of whole
    documents, or one longer document, are a shard with a suffix array over all its words; every test suffix that
    can be in it is searched there, by binary search for its first window, and matches go on as far as they can. ``matches`` has the longest verbatim matches with their places
    in words, ``items_sha256`` the ids of matched items, sorted as strings and joined by commas. Test
    items are broadcast in blocks of at most ``block_words`` words, so a task holds one block at a time.

    A null or wordless text has no words and no hits; a null item id is an empty string; items that
    share an id count once; an empty benchmark leaves every document clean; an empty table gives an empty
    result. Repeated rows give equal results, and ties in ``matches`` go by place. Other columns are not read, whatever
    they are called.
    """
    each = _sent(docs, bench, item_col, item_text_col, window, block_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_blocks(batches, 1, SHARD_BYTES):
            rows = scan_shard(texts, each())
            columns = list(zip(*rows)) or [()] * 7
            match = pa.list_(pa.struct([("item_id", pa.string()), ("item_word", pa.int64()), ("doc_word", pa.int64()), ("words", pa.int64())]))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.int64(), match)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))],
                                             names=[id_col, "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "longest_match", "matches"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col).alias("__text")).mapInArrow(released(run), f"`{id_col}` {kind}, {RESULT}")


def drop_contaminated(docs: DataFrame, bench: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
                      window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Rows of ``docs`` whose text holds no window of a test item; every column passes through the one scan, so
    rows that repeat an id, or have none, are judged by their own text."""
    each, at = _sent(docs, bench, item_col, item_text_col, window, block_words), place_of(docs, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_blocks(batches, at, SHARD_BYTES):
            yield batch.filter(pa.array([not row[4] for row in scan_shard(texts, each())], pa.bool_()))

    return docs.mapInArrow(released(run), docs.schema)

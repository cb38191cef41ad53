"""SimHash near-duplicates, with candidates pruned by the pigeonring principle (Qin and Xiao, 2018).

A 64-bit fingerprint is a ring of five segments. If two fingerprints differ in at most two bits, some
segment starts a chain of consecutive segments whose differences, summed over the first l segments,
never exceed l * 2 / 5. In whole bits the budgets are 0, 0, 1, 1, 2. So the first two segments of the chain
are equal, and as the third and the fourth differ in one bit together, one of these is equal too: that
makes two equi-keys a start, of 38 or 39 bits. What shares a key has its chains of three, four and five
segments checked, the last of which is the full Hamming check.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanternfish.llm.batches import released
from lanternfish.llm.bloom import bitmap_of, probe, repeated_words, words_for, words_of
from lanternfish.llm.store import apart, join_hot, one_of_each, written
from lanternfish.operators.graph import components, spanning

RESULT = ("fingerprint", "component_id")
SEED, MOST = 42, 2
WIDTHS = (13, 13, 13, 13, 12)
STARTS = (0, 13, 26, 39, 52)
#: Fingerprints of a key that a task pairs at once; a key of more is dealt out in blocks of so many, each of
#: which meets each in a cell of its own. Memory and balance only: every pair of a key meets the same filter.
SIDE, STEP = 8192, 1024


def fingerprint(text: bytes, words: int = 3) -> int:
    """SimHash of the shingles of ``words`` words in UTF-8 ``text``; 0 for a text without words."""
    from xxhash import xxh64_intdigest

    w = text.lower().split()  # bytes: A-Z only, and splits at the six ASCII white spaces
    if not w:
        return 0
    shingles = map(b" ".join, zip(*(w[i:] for i in range(words)))) if len(w) >= words else [b" ".join(w)]
    total, n = np.zeros(64, dtype=np.int64), 0
    hashes = np.fromiter((xxh64_intdigest(s, SEED) for s in shingles), dtype=np.uint64)
    for i in range(0, len(hashes), 1 << 16):
        part = hashes[i : i + (1 << 16)].astype(">u8")
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        n += len(part)
    return int.from_bytes(np.packbits(2 * total > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str, text_col: str, words: int = 3) -> DataFrame:
    """(__id, __fp) of each row; the bits of ``__fp`` as a signed long. A null text is an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            found = [fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"", words) for t in texts.cast(pa.large_binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(found, dtype=np.uint64).view(np.int64))], names=["__id", "__fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).mapInArrow(released(run), f"__id {kind}, __fp bigint")


def _mask(first: int, count: int) -> int:
    """Bits of ``count`` consecutive segments of the ring, from ``first``; segment 0 holds the high bits."""
    out = 0
    for s in range(first, first + count):
        s %= 5
        out |= ((1 << WIDTHS[s]) - 1) << (64 - STARTS[s] - WIDTHS[s])
    return out


def chain_keys(fp: Column) -> Column:
    """The ten equi-keys: for each start the bits of its first two segments and of the third or the fourth, and
    which of the ten it is in the low four bits."""
    keys = []
    for start in range(5):
        w = [WIDTHS[(start + i) % 5] for i in range(5)]
        turned = fp if start == 0 else F.shiftleft(fp, STARTS[start]).bitwiseOR(F.shiftrightunsigned(fp, 64 - STARTS[start]))
        third = F.shiftrightunsigned(turned, 64 - w[0] - w[1] - w[2])
        fourth = F.shiftrightunsigned(turned, 64 - w[0] - w[1] - w[2] - w[3]).bitwiseAND(F.lit((1 << w[3]) - 1))
        keys += [F.shiftleft(third, 4).bitwiseOR(F.lit(start)), F.shiftleft(F.shiftleft(F.shiftrightunsigned(turned, 64 - w[0] - w[1]), w[3]).bitwiseOR(fourth), 4).bitwiseOR(F.lit(8 + start))]
    return F.array(*keys)


_CHAINS = {n: np.array([_mask(s, n) for s in range(5)], dtype=np.uint64) for n in (3, 4)}


def chained(x: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Whether the differing bits ``x`` keep within the budgets of the chains from ``start``."""
    ok = np.bitwise_count(x & _CHAINS[3][start]) <= 1  # three segments
    ok &= np.bitwise_count(x & _CHAINS[4][start]) <= 1  # four
    return ok & (np.bitwise_count(x) <= MOST)  # and the whole ring


def link_chunk(cell: np.ndarray, fp: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of linked rows, enough to span each linked set; rows sorted by cell, whole cells only. All pairs of
    a cell are put to the chain filter, those of like distance in the order at once."""
    n = len(cell)
    if n < 2:
        return np.array([], dtype=int), np.array([], dtype=int)
    at = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
    after = np.repeat(np.r_[at[1:], n], np.diff(np.r_[at, n])) - np.arange(n)  # rows of the cell from here on
    a, b = [], []
    i, d = np.arange(n), 1
    while len(i := i[after[i] > d]):
        ok = i[chained(fp[i] ^ fp[i + d], start[i])]
        if len(ok):
            a.append(ok)
            b.append(ok + d)
        d += 1
    return spanning(np.concatenate(a), np.concatenate(b), n) if a else (np.array([], dtype=int), np.array([], dtype=int))


def _linker(side: int | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function of (cell, high, start, fp), sorted by cell and high, to links (a, b). Whole cells are paired within
    themselves, many at once; a cell of two blocks pairs each row of the lower one with each of the higher one.
    A cell of more than ``side`` rows is handed on: (a, cell, start) of each, with a null ``b``. Cells are numbered by
    hashes: where two share a number, more pairs are put to the filter, and none is lost."""
    def out(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        n = len(a)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int8())], names=["a", "b", "cell", "start"])

    def handed(c: np.ndarray, s: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(f.view(np.int64)), pa.nulls(len(f), pa.int64()), pa.array(c), pa.array(s)], names=["a", "b", "cell", "start"])

    def between(low: np.ndarray, start: np.ndarray, high: np.ndarray) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for lo in range(0, len(high), STEP):
            x, y = np.nonzero(chained(low[:, None] ^ high[None, lo : lo + STEP], start[:, None]))
            a.append(x)
            b.append(y + lo + len(low))
        both = np.r_[low, high]
        x, y = spanning(np.concatenate(a), np.concatenate(b), len(both))
        if len(x):
            yield out(both[x], both[y])

    def done(c: np.ndarray, h: np.ndarray, s: np.ndarray, f: np.ndarray) -> Iterator[pa.RecordBatch]:
        own = h == 0
        if side and len(c) > side:
            cells, n = np.unique(c, return_counts=True)
            large = np.isin(c, cells[n > side])
            if large.any():
                yield handed(c[large], s[large], f[large])
                own &= ~large
        a, b = link_chunk(c[own], f[own], s[own])
        if len(a):
            yield out(f[own][a], f[own][b])
        for cell in np.unique(c[h == 2]):
            low, high = (c == cell) & (h == 1), (c == cell) & (h == 2)
            if low.any():
                yield from between(f[low], s[low], f[high])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = [np.array([], dtype=t) for t in (np.int64, np.int8, np.int8, np.uint64)]
        held, spilling = none, None
        for batch in batches:
            new = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            held = [np.concatenate([old, x.astype(old.dtype) if i < 3 else x.view(np.uint64)]) for i, (old, x) in enumerate(zip(held, new))]
            if spilling is not None and len(held[0]):
                n = int(np.searchsorted(held[0], spilling, "right"))
                if n:
                    yield handed(held[0][:n], held[2][:n], held[3][:n])
                held = [x[n:] for x in held]
                spilling = None if len(held[0]) else spilling
            if len(held[0]):
                cut = int(np.searchsorted(held[0], held[0][-1], "left"))  # the last cell may go on
                yield from done(*(x[:cut] for x in held))
                held = [x[cut:] for x in held]
                if side and len(held[0]) > side:
                    spilling = held[0][0]
                    yield handed(held[0], held[2], held[3])
                    held = none
        yield from done(*held)

    return released(run)


LINKS = "a bigint, b bigint, cell bigint, start tinyint"


def near_links(fps: DataFrame, side: int = SIDE) -> DataFrame:
    """Links (a, b) between the distinct fingerprints ``fp`` that span every set linked by two bits or fewer.

    A key is a cell; a key of more than ``side`` fingerprints is dealt out in blocks of that many, and has a cell for
    each two of its blocks and each block alone."""
    keys = fps.select(F.explode(chain_keys(F.col("fp"))).alias("key"), "fp")
    start = F.col("key").bitwiseAND(F.lit(7)).cast("tinyint").alias("start")
    cells = keys.select(F.xxhash64("key").alias("cell"), F.lit(0).cast("tinyint").alias("high"), start, "fp")
    found = written(cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(_linker(side), LINKS), "simhash-links")
    links, handed = found.where("b is not null").select("a", "b"), found.where("b is null").select("cell", "start", F.col("a").alias("fp"))
    if handed.isEmpty():
        return links
    sizes = handed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / side).alias("blocks"))
    known = join_hot(handed, sizes, "cell", F.col("fp"), how="inner")
    blocks = known.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    high = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
    split = blocks.select(F.xxhash64("cell", F.least("own", "other"), F.greatest("own", "other")).alias("cell"), high.cast("tinyint").alias("high"), "start", "fp")
    more = split.repartition("cell").sortWithinPartitions("cell", "high").mapInArrow(_linker(None), LINKS)
    return links.unionByName(more.select("a", "b"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(id, fingerprint, component_id) of each row: 16 hex digits, and the smallest id that links reach.

    Fingerprints of up to two differing bits link. Texts are hashed once; equal fingerprints count once
    in the search, so groups of copies cost one row. A null or wordless text has fingerprint zero and is
    linked like any other. Rows that repeat an id get equal results each; null ids are passed over in
    component_id, which is null only if the component has no other. A very long text is hashed whole, in parts. Other
    columns are not read, whatever they are called. An empty table gives an empty result.
    """
    hashed = written(fingerprints(docs, id_col, text_col, words), "simhash")
    fps = written(hashed.groupBy(F.col("__fp").alias("fp")).agg(F.min("__id").alias("first"), F.count(F.lit(1)).alias("size")), "simhash-distinct")
    roots = components(near_links(fps.select("fp")), "simhash-components")  # (a, b): b is the least
    linked = roots.unionByName(roots.select(F.col("b").alias("a"), "b").distinct())
    members = written(linked.join(fps, F.col("a") == F.col("fp")).select("fp", "b", "first"), "simhash-members")
    least = members.groupBy("b").agg(F.min("first").alias("least"))
    known = join_hot(members, least, "b", F.col("fp"), how="inner").select("fp", "least")
    alike = fps.where("size > 1").join(known.select("fp"), "fp", "left_anti").select("fp", F.col("first").alias("least"))
    facts = known.unionByName(alike).withColumnRenamed("fp", "__fp")
    out = join_hot(hashed, facts.withColumn("__known", F.lit(True)), "__fp", F.col("__id"))
    return out.select(F.col("__id").alias(id_col), F.lower(F.lpad(F.hex("__fp"), 16, "0")).alias("fingerprint"),
                      F.when(F.col("__known"), F.col("least")).otherwise(F.col("__id")).alias("component_id"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """``docs`` with one row of each near-duplicate component: that of the smallest id, a null id being smallest.

    Rows are told apart by id and text, so each is judged by its own text where ids repeat; of rows that
    repeat both, one stays. Only rows of lost or repeated keys shuffle, with all their columns, whatever these are
    called. Nulls, empty and long texts and empty tables are as in :func:`near_dedup`.
    """
    held, back = apart(docs.columns)
    number, text = F.col(f"`{id_col}`"), F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    key = F.unhex(F.sha2(F.concat(F.sha2(text.cast("binary"), 256), F.coalesce(F.concat(F.lit("="), number.cast("string")), F.lit(""))).cast("binary"), 256))
    rows = docs.select(F.struct(number.alias("id"), key.alias("key")).alias("__row"), text.alias("__text"))
    found = written(near_dedup(rows, "__row", "__text", words).select("__row", (F.col("__row") != F.col("component_id")).alias("lost")), "simhash-verdicts")
    hashed = found.select(F.col("__row.key").alias("__key"), F.xxhash64("__row.key").alias("__h"), "lost")
    lost = hashed.where("lost")
    words = words_for(found.count())
    bitmap = bitmap_of(words_of(lost.select("__h"), words).unionByName(repeated_words(hashed.where("not lost").select("__h"), words)))
    # of each key that is lost or repeats, which; the rest of the rows that the filter flags stay as they are
    flagged = probe(hashed, F.col("__h"), bitmap, words).where("__maybe").groupBy("__key").agg(F.max("lost").alias("lost"), F.count(F.lit(1)).alias("n"))
    facts = written(flagged.where("lost or n > 1").select("__key", "lost"), "simhash-facts")
    looked = probe(docs.select(key.alias("__key"), *held), F.xxhash64("__key"), bitmap, words)
    met = join_hot(looked.where("__maybe").drop("__maybe"), facts, "__key", F.spark_partition_id())
    one = one_of_each(met.where("not lost").drop("lost"), "__key")
    return looked.where("not __maybe").select(*back).unionByName(met.where("lost is null").select(*back)).unionByName(one.select(*back))

"""Spelling variants: words one letter apart, found in forward and backward automata (Mihov and Schulz, 2004).

A word is cut in half. What is one error away keeps the first half or the second one whole: the first half is
read in an automaton of the words, the second half backwards in one of the words reversed, and the rest is completed
with one error. So words meet only with those that begin or end alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanternfish.llm.automaton import Automaton
from lanternfish.llm.batches import released
from lanternfish.llm.store import forget, join_hot, picked, written

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LETTERS = "A-Za-zÀ-ÿ"
#: Letters of the words that a task holds on average, words of one beginning or end that one cell holds, parts that such words
#: ask in from one cell, and keys of more words than that which are sent to every task. Memory and balance only.
LETTERS_EACH, HELD, ASKS, SENT = 150_000, 4096, 4, 1_000_000


def counted_words(docs: DataFrame, least: int = 7, spoil: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): the runs of letters (A-Z, a-z, U+00C0 to U+00FF) of whole texts, A-Z lower-cased, of at least ``least`` code points.

    With ``spoil``, a run of whose id and letters the CRC-32 is a multiple of it first loses the letter that the
    CRC-32 names; a null id is written as nothing. A null text has no words. Counts are summed in each task before they shuffle.
    """
    low = F.translate(F.col("text"), UPPER, UPPER.lower())
    rows = picked(docs, id_col, text_col).toDF("id", "text").select("id", F.explode(F.regexp_extract_all(low, F.lit(f"[{LETTERS}]{{{least},}}"), F.lit(0))).alias("run"))
    word = F.col("run")
    if spoil:
        rows = rows.withColumn("h", F.crc32(F.concat(F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(":"), F.col("run")).cast("binary")))
        at = (F.col("h") % F.length("run")).cast("int")
        word = F.when(F.col("h") % spoil == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))).otherwise(word)
    return rows.select(word.alias("word")).where(F.length("word") >= least).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def _key_size(half: Column) -> Column:
    """The greatest of 1, 2, 3, 4, 6, 8, 12, 16, ... up to ``half``: words whose halves differ by a letter mostly share it."""
    half = F.greatest(half, F.lit(1))
    power = F.pow(F.lit(2.0), F.floor(F.log2(half)))
    return F.when(half >= 1.5 * power, 1.5 * power).otherwise(power).cast("int")


def _dealt(words: DataFrame) -> DataFrame:
    """(key, back, asks, word, n): each word under the beginnings (``back``: ends) of which words one letter away read the
    half; ``asks`` where it is the word's own."""
    size = F.length("word")
    even, first = size % 2 == 0, F.floor(size / 2)
    last = size - first
    own = F.when(F.col("d.back"), _key_size(last)).otherwise(_key_size(first))
    # a word that is a letter shorter or longer may have another half
    ways = [(False, first), (False, F.when(even, first - 1).otherwise(first + 1)), (True, last), (True, F.when(even, last + 1).otherwise(last - 1))]
    keys = F.array_distinct(F.array(*[F.struct(F.lit(back).alias("back"), _key_size(half).alias("size")) for back, half in ways]))
    rows = words.withColumn("d", F.explode(keys))
    part = F.when(F.col("d.back"), F.right("word", F.col("d.size"))).otherwise(F.left("word", F.col("d.size")))
    return rows.select(F.xxhash64("d.back", "d.size", part).alias("key"), F.col("d.back").alias("back"), (F.col("d.size") == own).alias("asks"), "word", "n")


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near words of (back, part, parts, asks, holds, word, n): rows that hold come first, and stay; the others stream."""
    held: tuple[dict[str, int], dict[str, int]] = ({}, {})
    automata: list[tuple[list[str], Automaton]] = []

    def near(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        if not automata:
            for words in held:
                order = sorted(words)
                automata.append((order, Automaton(order)))
        out: list[tuple] = []
        for back, part, parts, asks, _, word, n in rows:
            if not asks:
                continue
            order, automaton = automata[back]
            first = word[: len(word) // 2]
            way, exact = (word[::-1], len(word) - len(first)) if back else (word, len(first))
            for number in automaton.one_error(way, exact):
                count, other = held[back][order[number]], order[number]
                if back:
                    other = other[::-1]
                    if other.startswith(first):  # found forwards
                        continue
                if parts == 1 or crc32(other.encode()) % parts == part:  # else another cell of this key has it
                    out.append((word, n, other, count))
        if out:
            yield pa.RecordBatch.from_arrays(list(map(pa.array, zip(*out))), names=["word", "n", "near", "near_n"])

    own: list[tuple] = []
    for b in batches:
        rows = list(zip(*(c.to_pylist() for c in b.columns)))
        holding = [r for r in rows if r[4]]
        for back, _, _, _, _, word, n in holding:
            held[back][word[::-1] if back else word] = n
        own += holding
        if len(holding) < len(rows):
            yield from near(own)
            yield from near([r for r in rows if not r[4]])
            own = []
    yield from near(own)


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, near, near_n): each two words of ``words`` (word, n; distinct, of two code points or more) that differ by exactly one code
    point inserted, deleted or replaced, in both orders, once each.

    Words are dealt out by what they begin and end with, once or twice each way. A beginning or end of over HELD words
    is several parts: each word lies in one of them and asks in all; if ASKS times as many ask, they do so in several cells. So
    no group is one task's, a task's memory is bounded, and every pair is met once.
    A task builds the two automata of the words it holds and reads them for those that ask. Null words and
    shorter ones are near to nothing.
    """
    known = words.where(F.length("word") >= 2).select("word", F.col("n").cast("bigint").alias("n"))
    dealt = written(_dealt(known), "spelling-keys")
    hot = written(dealt.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / HELD).cast("int").alias("parts")).where("parts > 1"), "spelling-hot")
    size = dealt.agg(F.coalesce(F.sum(F.length("word")), F.lit(0))).first()[0]
    few = hot.count()
    found = dealt.withColumn("parts", F.lit(None).cast("int")) if not few else dealt.join(F.broadcast(hot), "key", "left") if few <= SENT else join_hot(dealt, hot, "key", F.col("word"))
    own = F.pmod(F.crc32(F.col("word").cast("binary")), F.col("parts")).cast("int")
    crowds = F.ceil(F.col("parts") / ASKS).cast("int")
    cell = lambda part, crowd, holds, asks: F.struct(part.cast("int").alias("part"), crowd.cast("int").alias("crowd"), holds.alias("holds"), asks.alias("asks"))
    lies = F.transform(F.sequence(F.lit(0), crowds - 1), lambda c: cell(own, c, F.lit(True), F.lit(False)))
    ask = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: cell(p, F.pmod(F.xxhash64("word"), crowds), F.lit(False), F.lit(True)))
    alone = F.array(cell(F.lit(0), F.lit(0), F.lit(True), F.col("asks")))
    cells = F.when(F.col("parts").isNull(), alone).when(F.col("asks"), F.concat(lies, ask)).otherwise(lies)
    rows = found.withColumn("c", F.explode(cells)).select("key", "back", F.col("c.part").alias("part"), F.coalesce("parts", F.lit(1)).alias("parts"), F.col("c.asks").alias("asks"), F.col("c.holds").alias("holds"), "word", "n", F.col("c.crowd").alias("crowd"))
    rows = rows.repartition(max(1, -(-size // LETTERS_EACH)), "key", "part", "crowd").sortWithinPartitions(F.desc("holds")).drop("key", "crowd")
    return rows.mapInArrow(released(_search), "word string, n bigint, near string, near_n bigint")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of ``forms`` (word, root: the next one): the last word that each reaches. Steps double in each round, and counts grow at each step,
    so rounds are few and come to an end."""
    now = written(forms, "spelling-forms")
    while True:
        # many words may have one form
        step = join_hot(now, now.select(F.col("word").alias("root"), F.col("root").alias("further")), "root", F.col("word"))
        then = written(step.select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "spelling-forms")
        moved = not then.where("moved").isEmpty()
        forget(now)
        now = then
        if not moved:
            return now.select("word", "root")


def variant_groups(words: DataFrame, ratio: int = 10) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of ``words`` (word, n; distinct).

    A word's form is its near word (:func:`near_words`) of greatest n, of equals the least in code-point order, if that n is at
    least ``ratio`` (over 1) times its own; ``root`` is the last word that forms lead to, the word itself without a form. Rows
    without a word are left out; an empty table gives an empty result.
    """
    if ratio <= 1:
        raise ValueError("a form must be more frequent than its variants")
    known = written(words.where("word is not null").select("word", F.col("n").cast("bigint").alias("n")), "spelling-words")
    near = near_words(known).unionByName(known.select("word", "n", F.lit(None).cast("string").alias("near"), F.lit(None).cast("bigint").alias("near_n")))
    best = F.min(F.when(F.col("near").isNotNull(), F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("word"))))
    judged = near.groupBy("word").agg(F.max("n").alias("n"), F.count("near").alias("n_near"), best.alias("best"))
    is_form = -F.col("best.n") >= ratio * F.col("n")
    judged = written(judged.select("word", F.when(is_form, F.col("best.word")).alias("form"), "n", "n_near", F.when(is_form, -F.col("best.n")).alias("form_n")), "spelling-judged")
    roots = _roots(judged.where("form is not null").select("word", F.col("form").alias("root")))
    return judged.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, least: int = 7, seen: int = 2, spoil: int | None = None, ratio: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """:func:`variant_groups` of the words of ``docs`` (:func:`counted_words`) that occur at least ``seen`` times.

    Whole texts are read, also very long ones, and words of any length are compared whole. Null and empty texts have no
    words; rows that repeat count again; an empty table gives an empty result; other columns are not read.
    """
    return variant_groups(counted_words(docs, least, spoil, id_col, text_col).where(F.col("n") >= seen), ratio)

"""Two-pass Bloom filtering of 64-bit hashes, with DataFrame functions only.

Pass one is a Bloom filter that tells bits seen once from bits seen twice. A hash sets one bit of one
word of 64 bits; every task keeps, for each word that it meets, the bits seen and how often a bit was set
(`bit_or` and a count, summed before the shuffle), and words of all tasks merge by the same two
operations. A word that was set more often than it has bits holds a bit that was set twice: its hashes
may be repeated. Words whose every bit was set once drop out, and so do all their rows. A hot hash is one
word a task. What a task sends is bounded by the words, whatever its rows, and by its rows.

Pass two looks each row's word up in a bitmap of the words that remain, which is broadcast.

There are four words a hash, rounded up to a power of two, and :data:`MOST_WORDS` at most, so the bitmap has at
most 64 MB: the bound of the broadcast. Beyond some 130 million hashes words are shared by more
hashes, so more rows are taken for possible repeats and shuffle: about a share of 1 - exp(-r / words) of
the rows that occur once, where r is the number of hashes that repeat. Results stay the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanternfish.llm.store import apart, written

#: Words of a bitmap of 4 KB; the least and the greatest number of words.
GROUP, LEAST_WORDS, MOST_WORDS = 1 << 15, 1 << 15, 1 << 29


def words_for(hashes: int) -> int:
    """Words of the filter of so many hashes, a power of two."""
    return min(MOST_WORDS, max(LEAST_WORDS, 1 << (4 * hashes - 1).bit_length()))


def _word(h: Column, words: int) -> Column:
    return F.shiftrightunsigned(h, 6).bitwiseAND(F.lit(words - 1))


def repeated_words(hashes: DataFrame, words: int) -> DataFrame:
    """(word) of every word that holds a bit which two rows of the only column of ``hashes`` set."""
    h = F.col(hashes.columns[0])
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), h.bitwiseAND(F.lit(63)).cast("int"))
    seen = hashes.where(h.isNotNull()).groupBy(_word(h, words).alias("word")).agg(F.bit_or(bit).alias("bits"), F.count(F.lit(1)).alias("set"))
    return seen.where(F.col("set") > F.bit_count("bits")).select("word")


def words_of(hashes: DataFrame, words: int) -> DataFrame:
    """(word) of every word that some row of the only column of ``hashes`` sets."""
    h = F.col(hashes.columns[0])
    return hashes.where(h.isNotNull()).select(_word(h, words).alias("word"))


def bitmap_of(marked: DataFrame) -> DataFrame:
    """(__block, __bits) of the bitmap that has a bit for every word in ``marked``, in pieces of GROUP words."""
    at = marked.select(F.shiftright("word", 15).alias("__block"), F.col("word").bitwiseAND(F.lit(GROUP - 1)).alias("__bit"))
    return written(at.groupBy("__block").agg(F.expr("bitmap_construct_agg(__bit)").alias("__bits")), "bloom")


def probe(rows: DataFrame, h: Column, bitmap: DataFrame, words: int) -> DataFrame:
    """``rows`` with ``__maybe``: whether the word of ``h`` is in the bitmap."""
    looked = rows.withColumn("__word", _word(h, words)).withColumn("__block", F.shiftright("__word", 15))
    looked = looked.join(F.broadcast(bitmap), "__block", "left")  # at most MOST_WORDS bits
    at = F.col("__word").bitwiseAND(F.lit(GROUP - 1))
    byte = F.conv(F.hex(F.substring(F.col("__bits"), F.shiftright(at, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.lit(1).bitwiseAND(F.call_function("shiftright", byte, at.bitwiseAND(F.lit(7)).cast("int"))) == 1
    return looked.withColumn("__maybe", F.coalesce(hit, F.lit(False))).drop("__bits", "__block", "__word")


def drop_ids(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """``rows`` without those whose ``key`` is in ``ids``: an anti-join that shuffles only rows which a
    Bloom filter of ``ids`` may hold; the rest pass straight through. Rows with a null key stay."""
    ids = written(ids.select(F.col(key).alias("__id")).where("__id is not null").distinct(), "ids")
    words = words_for(ids.count())
    held, back = apart(rows.columns)
    bitmap = bitmap_of(words_of(ids.select(F.xxhash64("__id").alias("__h")), words))
    looked = probe(rows.select(F.col(key).alias("__key"), *held), F.xxhash64("__key"), bitmap, words)
    maybe = looked.where("__maybe").join(ids, F.col("__key") == F.col("__id"), "left_anti")
    return looked.where("not __maybe").select(*back).unionByName(maybe.select(*back))

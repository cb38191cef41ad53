"""Text metrics of a candidate against references, from their papers: (item, candidate), (item, reference). Texts are split by ``split``: into
runs of letters and digits, or as scorers of captions do (``text.ptb_tokens``)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanternfish.functions.text import tokens
from lanternfish.operators import meteor
from lanternfish.operators.skew import join_hot
from lanternfish.sources.scratch import written


def ngrams(words: Column, n: int) -> Column:
    last = F.size(words) - n + 1
    return F.when(last > 0, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(F.array().cast("array<string>"))


def _counted(df: DataFrame, keys: list[str], most: int) -> DataFrame:
    """(keys, n, gram, c) for every length up to ``most``, in one pass."""
    def named(n: int) -> Column:
        return F.transform(ngrams(F.col("words"), n), lambda g: F.struct(F.lit(n).alias("n"), g.alias("gram")))

    grams = F.flatten(F.array(*[named(n) for n in range(1, most + 1)]))
    return df.select(*keys, F.explode(grams).alias("g")).groupBy(*keys, "g.n", "g.gram").agg(F.count(F.lit(1)).alias("c"))


def _pair(candidates: DataFrame, references: DataFrame, split: Callable[[Column], Column]) -> tuple[DataFrame, DataFrame]:
    """Tokens of candidates and references (numbered) of the items that have both, each written once: what makes
    candidates is a search, and the scores read both several times."""
    made = written(candidates.select("item", split(F.col("candidate")).alias("words")), "candidates")
    ref = references.join(made.select("item"), "item", "left_semi").select("item", "reference")
    # a number for each row, which stays as it is once it is written
    ref = written(ref.select("item", F.monotonically_increasing_id().alias("r"), split(F.col("reference")).alias("words")), "references")
    return made.join(ref.select("item"), "item", "left_semi"), ref


def bleu(candidates: DataFrame, references: DataFrame, most: int = 4, split: Callable[[Column], Column] = tokens) -> DataFrame:
    """One row (bleu, n): corpus BLEU with clipped n-grams and the closest reference's length."""
    cand, ref = _pair(candidates, references, split)
    sizes = cand.select("item", F.size("words").alias("c")).join(ref.select("item", F.size("words").alias("k")), "item")
    length = sizes.groupBy("item", "c").agg(F.min(F.struct(F.abs(F.col("k") - F.col("c")).alias("gap"), "k")).alias("m"))
    out = length.agg(F.sum("c").alias("c"), F.sum("m.k").alias("r"), F.count(F.lit(1)).alias("n"))
    top = _counted(ref, ["item", "r"], most).groupBy("item", "n", "gram").agg(F.max("c").alias("most"))
    met = _counted(cand, ["item"], most).join(top, ["item", "n", "gram"], "left").groupBy("n").agg(F.sum(F.least("c", F.coalesce("most", F.lit(0)))).alias("hit"), F.sum("c").alias("all"))
    # a length without a hit makes the product 0, and so does a length without n-grams
    mean = met.where("hit > 0").agg(F.count(F.lit(1)).alias("lengths"), F.avg(F.log(F.col("hit").cast("double") / F.col("all"))).alias("mean"))
    brevity = F.least(F.lit(1.0), F.exp(1.0 - F.try_divide(F.col("r").cast("double"), F.col("c"))))
    value = F.when(F.col("lengths") == most, brevity * F.exp("mean"))
    return out.join(F.broadcast(mean)).select(F.coalesce(value, F.lit(0.0)).alias("bleu"), "n")  # one row each


def gram_frequencies(references: DataFrame, most: int = 4, split: Callable[[Column], Column] = tokens) -> DataFrame:
    """(n, gram, df): in how many items of ``references`` (item, reference) each n-gram occurs; the row of n = 0 has the
    number of items. Tables of disjoint sets of items add up (:func:`merged_frequencies`), so a corpus is counted once, as it comes in."""
    words = references.select("item", split(F.col("reference")).alias("words"))
    df = _counted(words, ["item"], most).groupBy("n", "gram").agg(F.count(F.lit(1)).alias("df"))
    whole = references.agg(F.countDistinct("item").alias("df")).select(F.lit(0).alias("n"), F.lit(None).cast("string").alias("gram"), "df")
    return df.unionByName(whole)


def merged_frequencies(*tables: DataFrame) -> DataFrame:
    """The frequencies of all items of several disjoint sets."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out.groupBy("n", "gram").agg(F.sum("df").alias("df"))


def cider(candidates: DataFrame, references: DataFrame, most: int = 4, sigma: float = 6.0, frequencies: DataFrame | None = None,
          split: Callable[[Column], Column] = tokens) -> DataFrame:
    """(item, cider): CIDEr-D, with document frequencies over the items scored, or those of ``frequencies`` (:func:`gram_frequencies`), which
    then are not counted again."""
    cand, ref = _pair(candidates, references, split)
    rc, cc = written(_counted(ref, ["item", "r"], most), "grams"), _counted(cand, ["item"], most)
    if frequencies is None:
        items = ref.agg(F.countDistinct("item").alias("items"))
        df = rc.groupBy("n", "gram").agg(F.countDistinct("item").alias("df"))
    else:
        items, df = frequencies.where("n = 0").agg(F.sum("df").alias("items")), frequencies.where("n > 0")
    idf = F.log(F.col("items").cast("double")) - F.log(F.greatest(F.coalesce("df", F.lit(0)), F.lit(1)).cast("double"))
    # a text has a gram once, so a gram is a small share of the rows, and few salts will do
    weigh = lambda x: join_hot(x, df, ["n", "gram"], F.col("item"), salts=4).join(F.broadcast(items)).withColumn("w", F.col("c") * idf)
    rw, cw = written(weigh(rc), "weights"), weigh(cc)
    square = F.sqrt(F.sum(F.col("w") * F.col("w")))
    rn, cn = rw.groupBy("item", "r", "n").agg(square.alias("rn")), cw.groupBy("item", "n").agg(square.alias("cn"))
    both = rw.select("item", "r", "n", "gram", F.col("w").alias("rw")).join(cw.select("item", "n", "gram", F.col("w").alias("cw")), ["item", "n", "gram"])
    dots = both.groupBy("item", "r", "n").agg(F.sum(F.least("cw", "rw") * F.col("rw")).alias("dot"))
    near = dots.join(rn, ["item", "r", "n"]).join(cn, ["item", "n"])
    value = F.coalesce(F.try_divide(F.col("dot"), F.nullif(F.col("rn") * F.col("cn"), F.lit(0.0))), F.lit(0.0))
    per_ref = near.groupBy("item", "r").agg(F.sum(value).alias("s"))
    lengths = ref.select("item", "r", F.size("words").alias("rl")).join(cand.select("item", F.size("words").alias("cl")), "item")
    gap = F.col("cl") - F.col("rl")
    scored = lengths.join(per_ref, ["item", "r"], "left").withColumn("s", F.coalesce("s", F.lit(0.0)) * F.exp(-(gap * gap) / (2 * sigma * sigma)))
    return scored.groupBy("item").agg((10.0 * F.avg("s") / most).alias("cider"))


def lcs(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence. One integer holds a bit for each word of ``b``, cleared where the
    length grows by one, so a word of ``a`` costs a few operations on that integer and not a row of a table."""
    at: dict[str, int] = {}
    for j, w in enumerate(b):
        at[w] = at.get(w, 0) | 1 << j
    every = (1 << len(b)) - 1
    row = every
    for w in a:
        if here := row & at.get(w, 0):
            row = (row + here | row - here) & every
    return len(b) - row.bit_count()


def rouge_l_of(candidate: list[str], references: list[list[str]], beta: float = 1.2) -> float:
    if not candidate or not any(references):
        return 0.0
    found = [(lcs(candidate, r), len(r)) for r in references if r]
    p, r = max(n / len(candidate) for n, _ in found), max(n / size for n, size in found)
    return (1 + beta**2) * p * r / (r + beta**2 * p) if p and r else 0.0


def meteor_exact_of(candidate: list[str], references: list[list[str]]) -> float:
    """That of the best reference."""
    return max((meteor.score(candidate, r) for r in references), default=0.0)


def _scored(candidates: DataFrame, references: DataFrame, parts, kinds: list[str], split: Callable[[Column], Column]) -> DataFrame:
    """(item, parts): of each item the greatest of each of ``parts`` (candidate, reference). A pair of a candidate and a
    reference is a row, so an item of many references is no one task's; Arrow batches hold the words."""
    pairs = candidates.select("item", split(F.col("candidate")).alias("words")).join(references.select("item", split(F.col("reference")).alias("ref")), "item")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [parts(list(c), list(r)) for c, r in zip(b["words"], b["ref"])]
            yield pd.DataFrame({"item": b["item"], **{k: [float(g[i]) for g in got] for i, k in enumerate(kinds)}})

    schema = f"item {candidates.schema['item'].dataType.simpleString()}, " + ", ".join(f"{k} double" for k in kinds)
    return pairs.mapInPandas(run, schema).groupBy("item").agg(*[F.max(k).alias(k) for k in kinds])


def _rouge_parts(candidate: list[str], reference: list[str]) -> tuple[float, float]:
    n = lcs(candidate, reference) if candidate and reference else 0
    return n / max(1, len(candidate)), n / max(1, len(reference))


def rouge_l(candidates: DataFrame, references: DataFrame, beta: float = 1.2, split: Callable[[Column], Column] = tokens) -> DataFrame:
    """(item, rouge_l): of the greatest precision and the greatest recall over the references."""
    both = _scored(candidates, references, _rouge_parts, ["p", "r"], split)
    value = F.try_divide((1 + beta**2) * F.col("p") * F.col("r"), F.col("r") + beta**2 * F.col("p"))
    return both.select("item", F.coalesce(value, F.lit(0.0)).alias("rouge_l"))


def meteor_exact(candidates: DataFrame, references: DataFrame, split: Callable[[Column], Column] = tokens) -> DataFrame:
    """(item, meteor_exact): that of the best reference."""
    return _scored(candidates, references, lambda c, r: (meteor_exact_of(c, [r]),), ["meteor_exact"], split)


def compared(before: DataFrame, after: DataFrame, references: DataFrame, score=cider, name: str = "cider") -> DataFrame:
    """(item, before, after) of the items that have both candidates and a reference; frequencies are those of these items."""
    items = before.select("item").intersect(after.select("item"))
    kept = [score(c.join(items, "item", "left_semi"), references).select("item", F.col(name).alias(side)) for c, side in ((before, "before"), (after, "after"))]
    return kept[0].join(kept[1], "item")


def table(scores: dict[str, DataFrame]) -> DataFrame:
    """(metric, mean, n) of per-item scores, a row a metric: the last column of each is its score."""
    out = None
    for name, df in scores.items():
        part = df.agg(F.lit(name).alias("metric"), F.avg(df.columns[-1]).alias("mean"), F.count(F.lit(1)).alias("n"))
        out = part if out is None else out.unionByName(part)
    return out

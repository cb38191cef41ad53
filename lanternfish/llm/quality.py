"""Quality by co-training: a text view and a metadata view teach each other, then score together."""

from __future__ import annotations

import math
import pickle
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanternfish.llm.batches import released, text_blocks
from lanternfish.llm.decontaminate import words_of
from lanternfish.llm.samples import FIT_BYTES, first_ids, held_out, labelled, whole_rows
from lanternfish.llm.store import written
from lanternfish.llm.toxicity import logistic

#: Labelled rows of each class that the views are fitted on at most.
FIT_ROWS = 1500
#: Rounds, and the rows of each class that a view teaches the other in a round, as a share of the labelled rows that
#: it learnt from, drawn of all rows that it is surer of than SURE.
ROUNDS, TAUGHT, SURE = 3, 0.1, 0.9
#: Three or more of one mark in a row, as in rules and shouting.
RUNS = re.compile(rb"([^\w\s\x80-\xff])\1\1")
#: Bytes of text that are scored at once, in whole texts. Memory only.
BLOCK_BYTES = 1 << 20
SYMBOLS = b"#$%&*|<>{}[]()_=+@~^\\/"
DIGITS = [bytes([c]) for c in b"0123456789"]


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class TextView:
    """Words by naive Bayes weights, and how the text is written; nothing but the text."""

    def __init__(self):
        self.words: dict[bytes, float] = {}
        self.w, self.mean, self.sd = None, None, None

    def raw(self, text: bytes) -> list[float]:
        words = words_of(text)
        n, size = max(1, len(words)), max(1, len(text))
        parts = text.split()
        bad = sum(map(text.count, (SYMBOLS[i : i + 1] for i in range(len(SYMBOLS)))))
        get = self.words.get
        return [sum([get(w, 0.0) for w in words]) / n, bad / size, float(RUNS.search(text) is not None),
                len(set(words)) / n, sum(map(len, words)) / n, len(parts) / n, text.count(b".") / n, text.count(b",") / n, sum(map(text.count, DIGITS)) / size]

    def fit(self, texts: list[bytes], y: np.ndarray) -> None:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        for t, label in zip(texts, y):
            seen[int(label)].update(set(words_of(t)))
        n1, n0 = y.sum() + 1, (1 - y).sum() + 1
        both = seen[0] + seen[1]
        self.words = {w: math.log((seen[1][w] + 1) / (n1 + 1)) - math.log((seen[0][w] + 1) / (n0 + 1)) for w, k in both.items() if k >= 4}
        self.words = {w: v for w, v in self.words.items() if abs(v) > 0.2}
        self._fit(np.array([self.raw(t) for t in texts]), y)

    def _fit(self, x: np.ndarray, y: np.ndarray) -> None:
        self.mean, self.sd = x.mean(axis=0), x.std(axis=0) + 1e-9
        share = np.clip(y.mean(), 0.02, 0.98)
        self.w = logistic(self._ready(x), y, 2.0, weight=np.where(y == 1, 0.5 / share, 0.5 / (1 - share)))

    def _ready(self, x: np.ndarray) -> np.ndarray:
        return np.c_[np.ones(len(x)), np.clip((x - self.mean) / self.sd, -8, 8)]

    def logits(self, texts: list[bytes]) -> np.ndarray:
        return self._ready(np.array([self.raw(t) for t in texts])) @ self.w if texts else np.zeros(0)


class PageView(TextView):
    """Metadata: columns that describe the page, and its layout in lines; no word of it."""

    def __init__(self):
        super().__init__()
        self.values: list[tuple[int, str]] = []

    def raw_page(self, row: tuple) -> list[float]:
        lang, source, chars, lines, longest, mean, short, doubled = row
        n = max(1.0, chars)
        base = [math.log1p(n), math.log1p(lines), math.log1p(longest), math.log1p(mean), short, doubled, longest / n]
        return base + [float(row[k] == v) for k, v in self.values]

    def fit(self, rows: list[tuple], y: np.ndarray) -> None:
        self.values = [(k, v) for k in (0, 1) for v, n in sorted(Counter(r[k] for r in rows).items(), key=lambda x: (-x[1], str(x[0])))[:40] if n >= 5]
        self._fit(np.array([self.raw_page(r) for r in rows]), y)

    def logits(self, rows: list[tuple]) -> np.ndarray:
        return self._ready(np.array([self.raw_page(r) for r in rows])) @ self.w if rows else np.zeros(0)


def layout(text: bytes) -> tuple[float, float, float, float, float]:
    """(lines, bytes of the longest, mean bytes, share of short lines, share of lines that repeat)."""
    lines = text.split(b"\n")
    size = [len(x) for x in lines]
    return float(len(lines)), float(max(size)), sum(size) / len(lines), sum(n < 20 for n in size) / len(lines), 1 - len(set(lines)) / len(lines)


class Scorer:
    def __init__(self, text: TextView, page: PageView, platt: list[np.ndarray], joint: np.ndarray):
        self.text, self.page, self.platt, self.joint = text, page, platt, joint

    def score(self, texts: list[bytes], pages: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(joint score, calibrated text view, calibrated metadata view)."""
        a, b = (p[0] + p[1] * z for p, z in zip(self.platt, (self.text.logits(texts), self.page.logits(pages))))
        return sigmoid(self.joint[0] + self.joint[1] * a + self.joint[2] * b), sigmoid(a), sigmoid(b)


def by_id(rows: list[dict]) -> list[dict]:
    """Rows in an order that depends on them only."""
    return sorted(rows, key=lambda r: (str(r["__id"])[::-1], r["__text"] or b""))


def halves(known: list[dict]) -> tuple[list[dict], list[dict]]:
    """Of the labelled rows those that teach, and those that calibrate."""
    rows = by_id(known)
    return rows[::2], rows[1::2]


def teach(known: list[dict], taught: list[dict]) -> tuple[TextView, PageView] | None:
    """Both views, each fitted on the labelled rows that teach and on what the other has taught it (``__text_y``,
    ``__page_y``); None if a half of the labelled rows lacks a class."""
    first, second = halves(known)
    if len(known) < 8 or any(len({r["__y"] for r in half}) < 2 for half in (first, second)):
        return None
    text, page = TextView(), PageView()
    for view, ready, y in ((text, _text, "__text_y"), (page, _page, "__page_y")):
        more = [r for r in by_id(taught) if r[y] is not None]
        view.fit([ready(r) for r in first + more], np.array([r["__y"] for r in first] + [r[y] for r in more], dtype=float))
    return text, page


def prior_only(prior: float) -> Scorer:
    """Scores every text with ``prior``."""
    text, page, base = TextView(), PageView(), math.log(max(prior, 1e-3) / max(1 - prior, 1e-3))
    text.mean = text.sd = np.ones(9)
    text.w = np.zeros(10)
    page.mean = page.sd = np.ones(7)
    page.w = np.zeros(8)
    return Scorer(text, page, [np.array([0.0, 0.0])] * 2, np.array([base, 0.0, 0.0]))


def combined(views: tuple[TextView, PageView], known: list[dict], prior: float) -> Scorer:
    """The views calibrated and combined on the labelled rows that they were not taught."""
    _, hold = halves(known)
    y = np.array([r["__y"] for r in hold], dtype=float)
    share = y.mean()
    weight = np.where(y == 1, prior / share, (1 - prior) / (1 - share))
    z = [view.logits([ready(r) for r in hold]) for view, ready in zip(views, (_text, _page))]
    platt = [logistic(np.c_[np.ones(len(y)), x], y, 0.01, weight=weight) for x in z]
    both = np.c_[np.ones(len(y)), platt[0][0] + platt[0][1] * z[0], platt[1][0] + platt[1][1] * z[1]]
    return Scorer(*views, platt, logistic(both, y, 0.1, weight=weight))


def _text(row: dict) -> bytes:
    return row["__text"] or b""


def _page(row: dict) -> tuple:
    text = row["__text"] or b""
    return (row["__lang"], row["__source"], float(len(text) if row["__chars"] is None else row["__chars"]), *layout(text))


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality", lang_col: str = "lang",
            source_col: str = "source", chars_col: str = "n_chars", fit_most: int = FIT_ROWS, bytes_most: int = FIT_BYTES, rounds: int = ROUNDS, taught: float = TAUGHT, threshold: float = 0.5) -> DataFrame:
    """(id, held_out, score, predicted, text_score, page_score) of each row.

    The text view sees words and characters, the metadata view language, source, length and line layout.
    Each is fitted on a bounded sample of labelled rows (held-out ids left out): of the labelled ids that
    ``docs`` has, ``fit_most`` of each class, a row each, and ``bytes_most`` of text a class. In each of ``rounds``
    both views score all rows without a label that may be learnt from; of all that one is sure of, ``taught`` times
    the labelled rows that teach, of each class, the first by a hash, are added to what the other learns. Both are calibrated on labelled
    rows they did not learn from, and combined.

    Null texts are empty, null metadata is a value of its own; very long texts are features as any other. Rows that
    repeat each other get equal scores, and an id that repeats teaches once. Columns other than those named
    are not read, whatever they are called. Ties in what is taught go by id. Without labels of both classes every
    score is the labels' mean; an empty table gives an empty result.
    """
    columns = {"__text": F.col(text_col).cast("binary"), "__lang": F.col(lang_col), "__source": F.col(source_col), "__chars": F.col(chars_col).cast("double")}
    inputs = list(columns)
    ready = docs.select(F.col(id_col).alias("__id"), *[c.alias(k) for k, c in columns.items()])
    known = labelled(docs, labels, label, id_col)
    n = {r["__y"]: r["n"] for r in known.groupBy("__y").agg(F.count(F.lit(1)).alias("n")).collect()}
    prior = n.get(1, 0) / max(1, sum(n.values()))
    picked = first_ids(known.where("__y = 0"), fit_most).unionByName(first_ids(known.where("__y = 1"), fit_most))
    none = F.lit(None).cast("int")
    rows = whole_rows(ready, picked, "__id", inputs, "__text", F.col("__y"), bytes_most).withColumn("__text_y", none).withColumn("__page_y", none)
    free = ready.where(F.col("__id").isNotNull() & ~held_out(F.col("__id")))
    marked = labels.select(F.col(id_col).alias("__id")).distinct()

    def in_one_task(more: list[DataFrame], made) -> bytes:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            got = [r for b in batches for r in b.to_pylist()]
            model = made([r for r in got if r["__y"] is not None], [r for r in got if r["__y"] is None])
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

        whole = rows
        for t in more:
            whole = whole.unionByName(t)
        got = whole.repartition(1).mapInArrow(released(run), "model binary").first()
        return got[0] if got else pickle.dumps(None)

    more: list[DataFrame] = []  # what each round has taught
    views = in_one_task(more, teach)
    fits = pickle.loads(views) is not None
    most = max(1, int(taught * rows.count() / 2))
    for turn in range(rounds if fits else 0):
        # texts don't shuffle: rows with a label are scored too, and go when only ids and verdicts are left
        sure = written(written(_sure(free, inputs, views), "sure").join(marked, "__id", "left_anti"), "sure")
        for t in more:
            sure = sure.join(F.broadcast(t.select("__id")), "__id", "left_anti")  # at most ``most`` ids a class, view and round
        drawn = None
        for view, other in (("text", "page"), ("page", "text")):
            for y in (0, 1):
                part = first_ids(sure.where(F.col(f"{view}_says") == y).select("__id").distinct(), most, 1 + turn)
                part = part.select("__id", F.lit(y).alias(f"__{other}_y"), none.alias(f"__{view}_y"))
                drawn = part if drawn is None else drawn.unionByName(part)
        each = drawn.groupBy("__id").agg(F.max("__text_y").alias("__text_y"), F.max("__page_y").alias("__page_y"))
        new = whole_rows(ready, each, "__id", inputs, "__text", F.coalesce("__text_y", "__page_y"), bytes_most)
        more.append(written(new.withColumn("__y", none), "taught"))
        views = in_one_task(more, teach)

    model = in_one_task(more, lambda known, more: combined(teach(known, more), known, prior)) if fits else pickle.dumps(prior_only(prior))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = pickle.loads(model)
        for batch, texts in text_blocks(batches, 2, BLOCK_BYTES):
            s, a, b = scorer.score(texts, list(map(_page, batch.select(inputs).to_pylist())))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= threshold).astype(np.int32)), pa.array(a), pa.array(b)],
                                             names=[id_col, "held_out", "score", "predicted", "text_score", "page_score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return ready.select(F.col("__id").alias(id_col), held_out(F.col("__id")).alias("held_out"), *inputs).mapInArrow(released(run), f"`{id_col}` {kind}, held_out boolean, score double, predicted int, text_score double, page_score double")


def _sure(free: DataFrame, inputs: list[str], views: bytes) -> DataFrame:
    """(__id, text_says, page_says) of the rows whose label a view is sure of; null where it is not."""
    def says(z: np.ndarray) -> pa.Array:
        p = sigmoid(z)
        return pa.array((p > 0.5).astype(np.int32), mask=np.maximum(p, 1 - p) <= SURE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text, page = pickle.loads(views)
        for batch, texts in text_blocks(batches, 1, BLOCK_BYTES):
            a, b = says(text.logits(texts)), says(page.logits(list(map(_page, batch.select(inputs).to_pylist()))))
            out = pa.RecordBatch.from_arrays([batch.column(0), a, b], names=["__id", "text_says", "page_says"])
            yield out.filter(pc.or_(a.is_valid(), b.is_valid()))

    kind = free.schema["__id"].dataType.simpleString()
    return free.select("__id", *inputs).mapInArrow(released(run), f"__id {kind}, text_says int, page_says int")

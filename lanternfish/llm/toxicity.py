"""Toxicity: a linear-chain conditional random field tags words; its marginals make document scores."""

from __future__ import annotations

import math
import pickle
import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanternfish.llm.batches import released, text_blocks
from lanternfish.llm.decontaminate import words_of
from lanternfish.llm.samples import FIT_BYTES, first_ids, held_out, labelled, whole_rows
from lanternfish.llm.store import place_of

WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
#: Labelled rows of each class that the model is fitted on at most; the bound of the sample.
FIT_ROWS = 1000
#: A feature labels the words of toxic rows as toxic if so many of these rows have it, and its log odds are so high.
SHARE, ODDS = 0.02, 3.0
#: Lengths of the prefixes that are features beside the word.
PREFIXES = (3, 4, 5, 6, 7)
#: Words whose summed weights a worker remembers; then it starts anew. Speed only.
REMEMBERED = 300_000
#: Bytes of text that are tagged at once, in whole texts: the arrays of a chain take some 100 times as much. Memory only.
BLOCK_BYTES = 1 << 20
#: Words, in whole texts, whose chains are run at once while the field is fitted. Memory only.
FIT_WORDS = 1 << 17
THRESHOLD = 0.7


def _scan(step: np.ndarray, width: int = 256) -> np.ndarray:
    """Rows v[t], each proportional to (1, 1) step[0] ... step[t]; ``step`` is (n, 2, 2).

    Blocks of ``width`` steps are multiplied side by side, chained, and then run from their starts, so
    the Python loops are as long as a block and as the number of blocks, not as the text.
    """
    n = len(step)
    blocks = max(1, -(-n // width))
    m = np.empty((blocks * width, 2, 2))
    m[:n], m[n:] = step, np.eye(2)
    m = m.reshape(blocks, width, 2, 2).transpose(1, 2, 3, 0).copy()  # step, from, to, block
    p = m[0].copy()
    for k in range(1, width):
        p = np.stack([np.stack([p[i, 0] * m[k, 0, j] + p[i, 1] * m[k, 1, j] for j in (0, 1)]) for i in (0, 1)])
        if k % 8 == 0:
            p /= p.sum(axis=(0, 1))
    start = np.empty((2, blocks))
    v0 = v1 = 0.5
    for b, (a00, a01, a10, a11) in enumerate(p.reshape(4, blocks).T.tolist()):
        start[0, b], start[1, b] = v0, v1
        v0, v1 = v0 * a00 + v1 * a10, v0 * a01 + v1 * a11
        s = v0 + v1
        v0, v1 = v0 / s, v1 / s
    out = np.empty((width, 2, blocks))
    x, y = start
    for k in range(width):
        x, y = x * m[k, 0, 0] + y * m[k, 1, 0], x * m[k, 0, 1] + y * m[k, 1, 1]
        s = x + y
        x, y = x / s, y / s
        out[k, 0], out[k, 1] = x, y
    return out.transpose(2, 0, 1).reshape(-1, 2)[:n]


def forward_backward(emit: np.ndarray, first: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(forward, backward, marginal of state 1) of chains laid end to end. ``emit``: the log weight of
    state 1 against 0 at each word; ``first``: whether a chain starts there; ``trans``: log weights."""
    e = np.exp(np.clip(emit, -30, 30))
    t = np.exp(trans)
    step = np.empty((len(e), 2, 2))
    step[:, :, 0] = np.where(first[:, None], 1.0, t[:, 0])
    step[:, :, 1] = np.where(first[:, None], 1.0, t[:, 1]) * e[:, None]
    alpha = _scan(step)
    last = np.r_[first[1:], True]
    nxt = np.r_[e[1:], 1.0]
    # back[t] = M[t] back[t + 1], as rows from the right: transposed and turned round
    back = np.empty((len(e), 2, 2))
    for i in (0, 1):
        back[:, 0, i] = np.where(last, 1.0, t[i, 0])
        back[:, 1, i] = np.where(last, 1.0, t[i, 1] * nxt)
    beta = _scan(back[::-1])[::-1]
    both = alpha * beta
    return alpha, beta, both[:, 1] / both.sum(axis=1)


def features(word: bytes) -> list[str]:
    """The word itself and its prefixes."""
    text = word.decode()
    return ["=" + text, *[text[:k] for k in PREFIXES if k <= len(text)]]


class _Numbers(dict):
    """Numbers words as they are met."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class Tagger:
    """Features, their weights (at the word, at the word after, at the word before), transitions, document weights."""

    def __init__(self, names: list[str], weight: np.ndarray, bias: float, trans: np.ndarray, doc: np.ndarray):
        self.index = {f: i + 1 for i, f in enumerate(names)}
        self.weight, self.bias, self.trans, self.doc = weight, bias, trans, doc
        self.number, self.summed = _Numbers(), np.zeros((3, 0))  # words met so far and their weights

    def rows_of(self, words: list[bytes]) -> np.ndarray:
        """For each word the numbers of its features, filled up with 0, which has no weight."""
        out = np.zeros((len(words), len(PREFIXES) + 1), dtype=np.int64)
        get = self.index.get
        for i, w in enumerate(words):
            for k, f in enumerate(features(w)):
                if n := get(f):
                    out[i, k] = n
        return out

    def lay_out(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number of each word, whether a text starts there, words of each text)."""
        if len(self.number) > REMEMBERED:
            self.number, self.summed = _Numbers(), np.zeros((3, 0))
        parts = [np.fromiter(map(self.number.__getitem__, words_of(t)), dtype=np.int64) for t in texts]
        size = np.array([len(x) for x in parts], dtype=np.int64)
        ids = np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)
        first = np.zeros(len(ids), dtype=bool)
        first[(np.cumsum(size) - size)[size > 0]] = True
        return ids, first, size

    def emissions(self, ids: np.ndarray, first: np.ndarray, summed: np.ndarray) -> np.ndarray:
        own, before, after = summed
        e = own[ids] + self.bias
        e[1:] += np.where(first[1:], 0.0, before[ids[:-1]])
        e[:-1] += np.where(first[1:], 0.0, after[ids[1:]])
        return e

    def marginals(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        ids, first, size = self.lay_out(texts)
        if not len(ids):
            return np.zeros(0), size
        new = list(islice(self.number, self.summed.shape[1], None))
        self.summed = np.concatenate([self.summed, self.weight[:, self.rows_of(new)].sum(axis=2)], axis=1)
        return forward_backward(self.emissions(ids, first, self.summed), first, self.trans)[2], size

    def score(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        p, size = self.marginals(texts)
        z = doc_features(p, size) @ self.doc
        return 1 / (1 + np.exp(-np.clip(z, -500, 500))), p, size


def doc_features(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """What marginals say of a text: words tagged toxic, weighted by their marginals, the greatest and the
    second marginal, and the rate. Words below one half don't add up, or long clean texts would seem toxic."""
    out = np.zeros((len(size), 5))
    out[:, 0] = 1
    full = np.flatnonzero(size)
    if len(full):
        start = (np.cumsum(size) - size)[full]
        total = np.add.reduceat(np.where(p >= 0.5, p, 0.0), start)
        top = np.maximum.reduceat(p, start)
        owner = np.repeat(np.arange(len(full)), size[full])
        at = np.flatnonzero(p == top[owner])
        rest = p.copy()
        rest[at[np.unique(owner[at], return_index=True)[1]]] = 0
        out[full, 1] = np.log1p(total)
        out[full, 2] = top
        out[full, 3] = np.maximum.reduceat(rest, start)
        out[full, 4] = np.sqrt(total / size[full])
    return out


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30, weight: np.ndarray | None = None) -> np.ndarray:
    """Weights of a ridge logistic regression, by Newton's method; the first column is not shrunk."""
    w = np.zeros(x.shape[1])
    shrink = np.full(x.shape[1], ridge)
    shrink[0] = 1e-6
    c = np.ones(len(y)) if weight is None else weight
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (c * p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(shrink)
        step = np.linalg.solve(h, x.T @ (c * (y - p)) - shrink * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def token_lexicon(seen: np.ndarray, names: list[str], n: tuple[int, int]) -> np.ndarray:
    """Which features label words of toxic rows: common among these rows, rare among others. ``seen``:
    the rows of either class that have each feature; ``n``: the rows of either class."""
    n0, n1 = max(1, n[0]), max(1, n[1])
    odds = np.log((seen[1] + 0.5) / (n1 + 1)) - np.log((seen[0] + 0.5) / (n0 + 1))
    found = (seen[1] >= 2) & (odds >= ODDS) & (seen[1] >= SHARE * n1)
    if not found.any():
        best = sorted(np.flatnonzero(seen[1] >= 2), key=lambda i: (-odds[i] * math.log1p(seen[1][i]), names[i]))
        found[best[:10]] = True
    return found


def whole_runs(size: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """(first text, text after the last) of consecutive texts of ``most`` words together, or of one text."""
    lo, held = 0, 0
    for i, n in enumerate(size.tolist()):
        if i > lo and held + n > most:
            yield lo, i
            lo, held = i, 0
        held += n
    if lo < len(size):
        yield lo, len(size)


def fit(texts: list[bytes], toxic: np.ndarray, prior: float, epochs: int = 40) -> bytes:
    """A pickled :class:`Tagger` from whole texts and their labels; ``prior`` is the share of toxic rows among all."""
    first_of: dict[tuple[bytes, int], int] = {}
    for i, (t, y) in enumerate(zip(texts, toxic)):
        first_of.setdefault((b" ".join(t.split()), int(y)), i)
    keep = sorted(first_of.values())  # copies would outvote the rest
    texts, toxic = [texts[i] for i in keep], toxic[keep].astype(np.int64)
    if len(set(toxic.tolist())) < 2:  # nothing to tell apart: every text gets the prior
        return pickle.dumps(Tagger([], np.zeros((3, 1)), -5.0, np.zeros((2, 2)), np.array([math.log(max(prior, 1e-3) / max(1 - prior, 1e-3)), 0, 0, 0, 0])))
    tagger = Tagger([], np.zeros((3, 1)), -3.0, np.zeros((2, 2)), np.zeros(5))
    ids, first, size = tagger.lay_out(texts)
    number = _Numbers()  # features, as they are met in the words
    of_word = [np.fromiter(map(number.__getitem__, features(w)), dtype=np.int64) for w in tagger.number]
    known, seen = list(number), np.zeros((2, len(number)), dtype=np.int64)
    for y, x in zip(toxic, np.split(ids, np.cumsum(size)[:-1])):
        if len(x):
            seen[y, np.unique(np.concatenate([of_word[i] for i in np.unique(x)]))] += 1
    lexicon = token_lexicon(seen, known, (len(toxic) - int(toxic.sum()), int(toxic.sum())))
    names = sorted(f for f, k in zip(known, seen.sum(axis=0).tolist()) if k >= 3)
    n, m = len(names) + 1, len(of_word)
    marked = np.array([lexicon[x].any() for x in of_word], dtype=np.float64)
    words = list(tagger.number)
    del of_word, number, known
    tagger = Tagger(names, np.zeros((3, n)), -3.0, np.zeros((2, 2)), np.zeros(5))
    rows = tagger.rows_of(words)
    gold = marked[ids] * np.repeat(toxic, size)
    same = gold[:-1].astype(np.int8) * 2 + gold[1:].astype(np.int8)
    gold_pairs = np.bincount(same[~first[1:]], minlength=4).reshape(2, 2)
    theta, m1, m2 = np.concatenate([tagger.weight.ravel(), [tagger.bias], tagger.trans.ravel()]), 0.0, 0.0
    ends = np.r_[0, np.cumsum(size)]
    runs = [slice(ends[lo], ends[hi]) for lo, hi in whole_runs(size, FIT_WORDS) if ends[lo] < ends[hi]]
    per = max(1.0, gold.sum())
    for epoch in range(1, epochs + 1):
        summed, t = tagger.weight[:, rows].sum(axis=2), np.exp(tagger.trans)
        by_word, pairs, bias = np.zeros((3, m)), np.zeros((2, 2)), 0.0
        for run in runs:
            w, start = ids[run], first[run]
            emit, inner = tagger.emissions(w, start, summed), ~start[1:]
            alpha, beta, p = forward_backward(emit, start, tagger.trans)
            off = gold[run] - p
            by_word[0] += np.bincount(w, off, m)
            by_word[1] += np.bincount(w[:-1], np.where(inner, off[1:], 0), m)
            by_word[2] += np.bincount(w[1:], np.where(inner, off[:-1], 0), m)
            e = np.exp(np.clip(emit, -30, 30))[1:]
            pair = np.stack([alpha[:-1, i] * t[i, j] * (e if j else 1.0) * beta[1:, j] for i in (0, 1) for j in (0, 1)])
            pairs += (pair / pair.sum(axis=0))[:, inner].sum(axis=1).reshape(2, 2)
            bias += off.sum()
        grad = np.stack([np.bincount(rows.ravel(), np.repeat(x, rows.shape[1]), n) for x in by_word])
        g = np.concatenate([grad.ravel(), [bias], (gold_pairs - pairs).ravel()]) / per - 1e-4 * theta
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
        theta = theta + 0.2 / math.sqrt(1 + epoch / 20) * (m1 / (1 - 0.9**epoch)) / (np.sqrt(m2 / (1 - 0.99**epoch)) + 1e-6)
        tagger.weight, tagger.bias, tagger.trans = theta[: 3 * n].reshape(3, n), float(theta[3 * n]), theta[3 * n + 1 :].reshape(2, 2)
        tagger.weight[:, 0] = 0.0
    share = toxic.mean()
    weight = np.where(toxic == 1, prior / share, (1 - prior) / (1 - share))
    strong = np.flatnonzero(np.abs(tagger.weight[:, 1:]).max(axis=0) > 0.3) + 1
    model = Tagger([names[i - 1] for i in strong], tagger.weight[:, np.r_[0, strong]], tagger.bias, tagger.trans, tagger.doc)
    x = np.concatenate([doc_features(*model.marginals(texts[lo:hi])) for lo, hi in whole_runs(size, FIT_WORDS)])
    model.doc = logistic(x, toxic.astype(float), 0.1, weight=weight)
    model.number, model.summed = _Numbers(), np.zeros((3, 0))
    return pickle.dumps(model)


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic", most: int = FIT_ROWS, bytes_most: int = FIT_BYTES) -> bytes:
    """The model, fitted in one task on the bounded sample: of the labelled ids that ``docs`` has, ``most`` of each
    class at most, a row each, and ``bytes_most`` of text of each class at most. Only the model comes to the driver."""
    known = labelled(docs, labels, label, id_col)
    n = {r["__y"]: r["n"] for r in known.groupBy("__y").agg(F.count(F.lit(1)).alias("n")).collect()}
    prior = n.get(1, 0) / max(1, sum(n.values()))
    picked = first_ids(known.where("__y = 0"), most).unionByName(first_ids(known.where("__y = 1"), most))
    rows = whole_rows(docs.select(id_col, F.col(text_col).alias("__text")), picked, id_col, ["__text"], "__text", F.col("__y"), bytes_most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = sorted((r["__id"], r["__y"], (r["__text"] or "").encode()) for b in batches for r in b.to_pylist())
        model = fit([t for *_, t in got], np.array([y for _, y, _ in got], dtype=np.int64), prior)
        yield pa.RecordBatch.from_arrays([pa.array([model], pa.binary())], names=["model"])

    made = rows.select("__id", "__y", "__text").repartition(1).mapInArrow(released(run), "model binary").first()
    return made[0] if made else fit([], np.zeros(0, dtype=np.int64), prior)  # no labelled row, no task


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic",
             most: int = FIT_ROWS, bytes_most: int = FIT_BYTES, threshold: float = THRESHOLD) -> DataFrame:
    """(id, held_out, score, predicted, n_toxic, spans) of each row.

    Only texts are inputs of a score. Words of toxic rows that mark such rows are the labelled words; the
    field is fitted on at most ``most`` rows and ``bytes_most`` bytes of each class, held-out ids left out. A
    score is a logistic of the words' forward-backward marginals; ``spans`` are the words whose marginal is 0.5
    or more, as start and end in code points. A null or wordless text has no words and gets the score of none.
    A very long text is one chain, scanned in blocks. Repeated rows get equal results; of labelled rows that
    repeat an id one is learnt from. Columns other than the two are not read, whatever they are called. Without
    labels of both classes every score is the labels' mean; an empty table gives an empty result.
    """
    model = learn(docs, labels, id_col, text_col, label, most, bytes_most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = pickle.loads(model)
        for batch, texts in text_blocks(batches, 2, BLOCK_BYTES):
            score, p, size = tagger.score(texts)
            spans: list[list[dict]] = [[] for _ in texts]
            start = np.cumsum(size) - size
            for d in np.unique(np.searchsorted(start, np.flatnonzero(p >= 0.5), "right") - 1) if len(p) else ():
                while not size[d]:
                    d -= 1
                own = p[start[d] : start[d] + size[d]]
                for m, q in zip(WORD.finditer(texts[d].decode()), own.tolist()):
                    if q >= 0.5:
                        spans[d].append({"start": m.start(), "end": m.end(), "p": q})
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array(score), pa.array((score >= threshold).astype(np.int32)),
                pa.array([len(s) for s in spans], pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())])))],
                names=[id_col, "held_out", "score", "predicted", "n_toxic", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("__text")).mapInArrow(released(run), f"`{id_col}` {kind}, held_out boolean, score double, predicted int, n_toxic bigint, spans array<struct<start:bigint,end:bigint,p:double>>")


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic",
               most: int = FIT_ROWS, bytes_most: int = FIT_BYTES, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of ``docs`` whose score is below ``threshold``; every column passes through the one scan."""
    model = learn(docs, labels, id_col, text_col, label, most, bytes_most)
    at = place_of(docs, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = pickle.loads(model)
        for batch, texts in text_blocks(batches, at, BLOCK_BYTES):
            yield batch.filter(pa.array(tagger.score(texts)[0] < threshold))

    return docs.mapInArrow(released(run), docs.schema)

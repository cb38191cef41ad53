"""Exact greatest inner products by best-first search of M-trees (Ciaccia, Patella and Zezula, 1997).

Vectors of whole numbers are lifted to one length, M: each gets a coordinate more, sqrt(M^2 - |v|^2), and a query gets 0
there. The distance of a query and a vector is then sqrt(|q|^2 + M^2 - 2 q.v), so the nearest vectors are those of the greatest
products, and a metric tree finds them. The top of the tree is a page of routing vectors with covering radii,
fitted on a bounded sample; under each hang one or several trees of bounded size, whose pages are rows of a
written table. Pages hold each entry's distance to the routing vector above it, so that by the triangle inequality many entries are passed
over before their own distance is computed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanternfish.llm.batches import released
from lanternfish.llm.store import picked, written

#: Rows that routing vectors of the top page are chosen from at most, such vectors at most, and vectors under each where there are fewer.
SAMPLE, TOP, EACH = 16_384, 1024, 4096
#: Bytes of vectors of one tree, entries of a leaf page, children of an inner page, and queries that a tree is searched for at once.
TREE_BYTES, LEAF, FAN, BLOCK = 32 << 20, 128, 64, 512
NONE = -(1 << 62)
PAGE = "cell bigint, page int, leaf boolean, keys array<bigint>, values array<bigint>, above array<double>, radii array<double>"


def usable(vector: Column) -> Column:
    """Whether ``vector`` is there and each component is a finite number."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


def floored(vector: Column, scale: int) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale))


def _matrix(values: pa.Array, dims: int, exact: bool) -> np.ndarray:
    """Rows of ``dims`` whole numbers, shorter ones filled up with zeros. Products of floats are exact below 2^53, else integers are taken."""
    sizes = values.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = values.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), dims), dtype=np.float64 if exact else np.int64)
    if len(sizes) and (sizes == dims).all():
        return flat.astype(out.dtype).reshape(len(sizes), dims)
    out[np.arange(dims)[None, :] < sizes[:, None]] = flat
    return out


def _lifted(v: np.ndarray, most: float) -> np.ndarray:
    """``v`` with the coordinate that makes each as long as the longest, whose squared length is ``most``."""
    v = v.astype(np.float64)
    return np.c_[v, np.sqrt(np.maximum(most - (v * v).sum(axis=1), 0))]


def _apart(a: np.ndarray, b: np.ndarray, most: float) -> np.ndarray:
    """Distances of lifted vectors."""
    return np.sqrt(np.maximum(2 * (most - a @ b.T), 0))


def slack(most: float) -> float:
    """More than rounding can take from a distance; bounds give way by as much."""
    return 1e-6 * (1 + np.sqrt(most))


def _routes(w: np.ndarray, n: int) -> np.ndarray:
    """``n`` rows of ``w`` or fewer, all different: means of a few rounds, each replaced by the row nearest to it."""
    w = np.unique(w, axis=0)
    c = w[np.linspace(0, len(w) - 1, min(n, len(w))).astype(int)]
    for _ in range(4):
        own = (w @ c.T - (c * c).sum(axis=1) / 2).argmax(axis=1)
        total = np.zeros_like(c)
        np.add.at(total, own, w)
        count = np.bincount(own, minlength=len(c))[:, None]
        c = np.where(count > 0, total / np.maximum(count, 1), c)
    return np.unique(w[(c @ w.T - (w * w).sum(axis=1) / 2).argmax(axis=1)], axis=0)


def _pages(ids: np.ndarray, v: np.ndarray, most: float, route: np.ndarray, leaf: int = LEAF, fan: int = FAN) -> Iterator[tuple]:
    """(page, leaf, keys, values, above, radii) of an M-tree over ``v``, the root under the routing vector ``route`` being
    page 0. A page over at most ``leaf`` vectors holds them; another holds up to ``fan`` routing vectors of its
    own, each with its distance to the one above, its covering radius and the page of what is nearest to it."""
    w, pages = _lifted(v, most), 1
    waiting = [(0, np.arange(len(v)), route)]
    while waiting:
        page, at, above = waiting.pop()
        up = _apart(w[at], above[None, :], most)[:, 0]
        if len(at) <= leaf:
            yield page, True, ids[at], v[at], up, np.zeros(0)
            continue
        some = at[np.linspace(0, len(at) - 1, min(len(at), 16 * fan)).astype(int)]
        routes = _routes(w[some], min(fan, -(-2 * len(at) // leaf)))
        far = _apart(w[at], routes, most)
        own = far.argmin(axis=1)
        groups = [at[own == i] for i in range(len(routes))]
        if max(map(len, groups)) > len(at) - leaf // 2:  # mostly one vector: dealt evenly, under the same route
            routes = np.repeat(routes[np.bincount(own).argmax()][None, :], min(fan, -(-2 * len(at) // leaf)), axis=0)
            groups = np.array_split(at, len(routes))
        kept = [(g, r) for g, r in zip(groups, routes) if len(g)]
        radii = np.array([_apart(w[g], r[None, :], most).max() for g, r in kept])
        lead = np.array([r for _, r in kept])
        yield page, False, np.arange(pages, pages + len(kept)), lead[:, :-1].astype(v.dtype), _apart(lead, above[None, :], most)[:, 0], radii
        waiting += [(pages + i, g, r) for i, (g, r) in enumerate(kept)]
        pages += len(kept)


class Tree:
    """The pages of one tree, and best-first search of it for a block of queries."""

    def __init__(self, pages: list[tuple], most: float):
        self.pages, self.most, self.slack = {p[0]: p[1:] for p in pages}, most, slack(most)
        #: Distances computed, and passed over by the stored distance to the routing vector above.
        self.computed = self.avoided = 0

    def search(self, q: np.ndarray, own: np.ndarray, floor: np.ndarray, k: int, route: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores), n x k, of the vectors of greatest product with each of the ``q`` rows, of equals the least id, without
        those called ``own``; only scores of ``floor`` or more count. ``route`` are the queries' distances to the routing
        vector of the root. Missing ones have the score NONE.

        Each query first follows its nearest pages until it knows ``k`` vectors; then the page with the least bound of all is
        read for every query that still needs it, until no bound is below the distance of a query's k-th best."""
        n, size = len(q), max(self.pages) + 1
        self.q, self.own, self.k, self.floor = q, own, k, floor.copy()
        self.length = (q.astype(np.float64) ** 2).sum(axis=1) + self.most
        self.ids, self.score = np.full((n, k), np.iinfo(np.int64).max), np.full((n, k), NONE, dtype=np.int64)
        self.bound, self.route = np.full((n, size), np.inf), np.zeros((n, size))
        self.bound[:, 0], self.route[:, 0] = 0.0, route
        self.far = self._reach(slice(None))
        while len(new := np.flatnonzero((self.score[:, -1] == NONE) & np.isfinite(self.bound.min(axis=1)))):
            page = self.bound[new].argmin(axis=1)
            for p in np.unique(page):
                self._read(int(p), new[page == p])
        while True:
            self.bound[self.bound > self.far[:, None]] = np.inf
            p = int(self.bound.min(axis=0).argmin())
            who = np.flatnonzero(np.isfinite(self.bound[:, p]))
            if not len(who):
                return self.ids, self.score
            self._read(p, who)

    def _reach(self, who) -> np.ndarray:
        """The greatest distance at which a vector can still count."""
        least = self.floor[who]
        return np.where(least == NONE, np.inf, np.sqrt(np.maximum(self.length[who] - 2.0 * least, 0)) + self.slack)

    def _read(self, p: int, who: np.ndarray) -> None:
        leaf, keys, values, above, radii = self.pages[p]
        self.bound[who, p] = np.inf
        reach = self.far[who][:, None] + (0 if leaf else radii[None, :])
        need = np.abs(self.route[who, p][:, None] - above[None, :]) <= reach + self.slack
        some = np.flatnonzero(need.any(axis=0))
        self.computed += len(who) * len(some)
        self.avoided += len(who) * (len(keys) - len(some))
        if not len(some):
            return
        need, keys, s = need[:, some], keys[some], self.q[who] @ values[some].T
        if not leaf:
            d = np.sqrt(np.maximum(self.length[who][:, None] - 2.0 * s, 0))
            self.bound[np.ix_(who, keys)] = np.where(need, np.maximum(d - radii[some][None, :], 0), np.inf)
            self.route[np.ix_(who, keys)] = d
            return
        s = s.astype(np.int64)
        x, y = np.nonzero(need & (s >= self.floor[who][:, None]) & (keys[None, :] != self.own[who][:, None]))
        if not len(x):
            return
        rows = np.unique(x)
        at, k = who[rows], self.k
        which = np.r_[np.repeat(rows, k), x]
        ids, score = np.r_[self.ids[at].ravel(), keys[y]], np.r_[self.score[at].ravel(), s[x, y]]
        order = np.lexsort((ids, -score, which))
        keep = order[np.searchsorted(which[order], rows)[:, None] + np.arange(k)[None, :]]
        self.ids[at], self.score[at] = ids[keep], score[keep]
        self.floor[at] = np.maximum(self.floor[at], self.score[at, -1])
        self.far[at] = self._reach(at)


class Index:
    """Trees over ``rows`` (vec_id, v: whole numbers): ``pages`` is a written table, ``routes`` the lifted routing vectors of the top page."""

    def __init__(self, rows: DataFrame, tree_bytes: int = TREE_BYTES, each: int = EACH):
        spark = rows.sparkSession
        length = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
        size = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size("v")), F.lit(0)).alias("d"), F.coalesce(F.max(length), F.lit(0.0)).alias("m")).first()
        self.rows, self.n, self.dims, self.most = rows, size["n"], size["d"], size["m"]
        self.exact = self.most < 1 << 52
        self.routes, self.cells, self.pages = np.zeros((0, self.dims + 1)), np.zeros((0, 3)), None
        if not self.n:
            return
        dims, most, exact, top = self.dims, self.most, self.exact, min(TOP, -(-self.n // each))
        picked_rows = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(SAMPLE)

        def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            got = [_matrix(b.column(0), dims, exact) for b in batches if b.num_rows]
            if got:
                found = _routes(_lifted(np.concatenate(got), most), top)
                yield pa.RecordBatch.from_arrays([pa.array(found.tolist(), pa.list_(pa.float64()))], names=["r"])

        # a bounded sample in one task; TOP vectors at most come to the driver
        self.routes = np.array([r[0] for r in picked_rows.select("v").repartition(1).mapInArrow(choose, "r array<double>").collect()])
        sent = spark.sparkContext.broadcast(self.routes)

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for lo in range(0, b.num_rows, 4096):
                    part = b.slice(lo, 4096)
                    own = (_lifted(_matrix(part.column(1), dims, exact), most) @ sent.value.T).argmax(axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), *part.columns], names=["own", "vec_id", "v"])

        dealt = written(rows.mapInArrow(deal, "own bigint, vec_id bigint, v array<bigint>"), "mtree-dealt")
        held = max(1, tree_bytes // (8 * (dims + 1)))
        parts = dealt.groupBy("own").agg(F.ceil(F.count(F.lit(1)) / held).alias("parts"))  # TOP rows at most
        cell = F.col("own") * (1 << 32) + F.pmod(F.xxhash64("vec_id", "v"), F.col("parts"))

        def build(batch: pa.Table) -> pa.Table:
            number = batch.column("cell")[0].as_py()
            ids, v = batch.column("vec_id").to_numpy(), np.concatenate([_matrix(c, dims, exact) for c in batch.column("v").chunks])
            order = np.argsort(ids, kind="stable")
            made = list(_pages(ids[order], v[order], most, sent.value[number >> 32]))
            whole = lambda x: x.astype(np.int64)
            return pa.table([pa.array([number] * len(made)), pa.array([p[0] for p in made], pa.int32()), pa.array([p[1] for p in made]), pa.array([whole(p[2]) for p in made], pa.list_(pa.int64())),
                             pa.array([whole(p[3]).ravel() for p in made], pa.list_(pa.int64())), pa.array([p[4] for p in made], pa.list_(pa.float64())), pa.array([p[5] for p in made], pa.list_(pa.float64()))],
                            names=["cell", "page", "leaf", "keys", "values", "above", "radii"])

        self.pages = written(dealt.join(F.broadcast(parts), "own").select(cell.alias("cell"), "vec_id", "v").groupBy("cell").applyInArrow(build, PAGE), "mtree-pages")
        # the greatest distance in a tree to its routing vector: a row a tree
        radius = F.when(F.col("leaf"), F.array_max("above")).otherwise(F.array_max(F.zip_with("above", "radii", lambda a, r: a + r)))
        tops = self.pages.where("page = 0").select("cell", radius.alias("radius")).orderBy("cell").collect()
        self.cells = np.array([(c >> 32, c, r) for c, r in tops])

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """(query_id, vec_id, score) of at least the ``k`` greatest products of each of ``queries`` (query_id, v; one row an id) with rows
        of other ids. Each query asks the tree of its nearest routing vector first; the score of its k-th best
        there bounds which other trees it goes to, and what these return."""
        if not self.n:
            return queries.sparkSession.createDataFrame([], "query_id bigint, vec_id bigint, score bigint")
        first = written(self._ask(queries.withColumn("floor", F.lit(None).cast("bigint")), k, True), "mtree-first")
        floors = first.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("floor"))
        rest = self._ask(queries.join(floors, "query_id", "left"), k, False)
        return first.unionByName(rest)

    def _ask(self, queries: DataFrame, k: int, home: bool) -> DataFrame:
        dims, most, exact, spare = self.dims, self.most, self.exact, slack(self.most)
        sent = queries.sparkSession.sparkContext.broadcast((self.routes, self.cells))

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            routes, cells = sent.value
            own, numbers, radii = cells[:, 0].astype(int), cells[:, 1].astype(np.int64), cells[:, 2]
            for b in batches:
                for lo in range(0, b.num_rows, 1024):
                    part = b.slice(lo, 1024)
                    q = _matrix(part.column(1), dims, exact).astype(np.float64)
                    length = (q * q).sum(axis=1) + most
                    d = np.sqrt(np.maximum(length[:, None] - 2 * (q @ routes[:, :-1].T), 0))[:, own]
                    nearest = d.argmin(axis=1)
                    floor = part.column(2).to_numpy(zero_copy_only=False).astype(np.float64)
                    far = np.where(np.isnan(floor), np.inf, np.sqrt(np.maximum(length - 2 * np.nan_to_num(floor), 0)) + spare)
                    go = np.zeros(d.shape, dtype=bool)
                    if home:
                        go[np.arange(len(q)), nearest] = True
                    else:
                        go = d - radii[None, :] <= far[:, None] + spare
                        go[np.arange(len(q)), nearest] = False
                    x, y = np.nonzero(go)
                    take = part.take(pa.array(x))
                    yield pa.RecordBatch.from_arrays([pa.array(numbers[y]), take.column(0), take.column(1), take.column(2), pa.array(d[x, y])], names=["cell", "query_id", "v", "floor", "route"])

        # the row that a query has in each tree it goes to; pages come first in a cell
        asked = queries.select("query_id", "v", "floor").mapInArrow(route, "cell bigint, query_id bigint, v array<bigint>, floor bigint, route double")
        empty = F.lit(None)
        rows = self.pages.select("cell", F.lit(False).alias("asks"), F.col("page").cast("bigint").alias("key"), "leaf", "keys", "values", "above", "radii", empty.cast("bigint").alias("floor"), empty.cast("double").alias("route")).unionByName(
            asked.select("cell", F.lit(True).alias("asks"), F.col("query_id").alias("key"), empty.cast("boolean").alias("leaf"), empty.cast("array<bigint>").alias("keys"), F.col("v").alias("values"),
                         empty.cast("array<double>").alias("above"), empty.cast("array<double>").alias("radii"), "floor", "route"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cell, pages, tree = None, [], None
            for b in batches:
                cells, asks, key = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
                cut = np.flatnonzero(np.r_[True, (cells[1:] != cells[:-1]) | (asks[1:] != asks[:-1])]) if len(cells) else []
                for lo, hi in zip(cut, [*cut[1:], len(cells)]):
                    if cells[lo] != cell:
                        cell, pages, tree = cells[lo], [], None
                    if not asks[lo]:
                        for i in range(lo, hi):
                            numbers = lambda c, i=i: b.column(c)[i].values.to_numpy(zero_copy_only=False)
                            v = numbers(5).reshape(-1, dims) if dims else np.zeros((len(b.column(4)[i]), 0))
                            pages.append((int(key[i]), b.column(3)[i].as_py(), numbers(4), v.astype(np.float64) if exact else v, numbers(6), numbers(7)))
                        continue
                    if not pages:
                        continue
                    tree = tree or Tree(pages, most)
                    for at in range(lo, hi, BLOCK):
                        part = b.slice(at, min(hi - at, BLOCK))
                        floor = np.array([NONE if f is None else f for f in part.column(8).to_pylist()], dtype=np.int64)
                        own = key[at : at + part.num_rows]
                        ids, score = tree.search(_matrix(part.column(5), dims, exact), own, floor, k, part.column(9).to_numpy())
                        ok = score > NONE
                        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own, ok.sum(axis=1))), pa.array(ids[ok]), pa.array(score[ok])], names=["query_id", "vec_id", "score"])

        return rows.repartition("cell").sortWithinPartitions("cell", "asks").mapInArrow(released(run), "query_id bigint, vec_id bigint, score bigint")


def top_products(queries: DataFrame, rows: DataFrame, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``queries`` the ``k`` rows of ``rows`` with another id of the greatest inner product,
    of equals the smallest id; all, if there are fewer. Components are floor(scale * x), x as a double, so products are whole numbers.

    Rows without an id, and vectors that are null or hold a null or a number that is not finite, take no part. A shorter
    vector counts as filled up with zeros, an empty one as zeros. Queries that repeat an id ask once, with the least vector;
    rows that repeat an id are candidates each. Products above 2^52 are computed in integers and are right as long as they fit one. Other columns are not
    read. An empty table gives an empty result. The search is exact: samples only choose routing vectors.
    """
    def whole(df: DataFrame) -> DataFrame:
        df = picked(df, id_col, vector_col).toDF("id", "vector")
        return df.where(F.col("id").isNotNull() & usable(F.col("vector"))).select(F.col("id").cast("bigint").alias("vec_id"), floored(F.col("vector"), scale).alias("v"))

    asked = whole(queries).groupBy("vec_id").agg(F.min("v").alias("v")).withColumnRenamed("vec_id", "query_id")
    found = Index(whole(rows)).search(asked, k)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

"""M-tree search, spelling variants and vector codes against plain versions, with nulls, empty and long values, ties, repeats and clashing names."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lanternfish.llm import codes, mtree, spelling
from lanternfish.llm.automaton import Automaton

VECTORS = "vec_id bigint, embedding array<float>, label int"
NAMES = ["v", "cell", "page", "own", "floor", "route", "score", "rank", "query_id", "key", "code", "error", "k", "word", "n", "id", "run", "h", "VECTOR"]


def with_names(df):
    return df.select("*", *[F.lit("x").alias(n) for n in NAMES])


def odd_vectors():
    """Clusters, copies, ties, repeated ids, and what takes no part."""
    rng = np.random.default_rng(5)
    middle = rng.normal(size=(6, 12))
    rows = [(i, (middle[i % 6] + rng.normal(size=12) * 0.05).astype(np.float32).tolist(), [1, 1, 1, 2, None, 3][i % 6]) for i in range(700)]
    rows += [(1000 + i, rows[7][1], 9) for i in range(300)]  # one vector, a third of all
    rows += [(50, rows[3][1], 1), (50, rows[3][1], 1), (None, rows[4][1], 2)]
    rows += [(2000, None, 1), (2050, [1.0, None] * 6, 1), (2100, [float("nan")] * 12, 1), (2150, [float("inf")] + [0.0] * 11, 1), (2200, [], 5), (2250, [0.5, -0.5], 5)]
    return rows


def taken(v, scale):
    if v is None or any(x is None or not np.isfinite(x) for x in v):
        return None
    return [int(np.floor(float(np.float32(x)) * scale)) for x in v]


def plain_top(rows, k, scale, dims=12):
    kept = [(i, w + [0] * (dims - len(w))) for i, v, _ in rows if i is not None and (w := taken(v, scale)) is not None]
    asked = {}
    for i, w in kept:
        if i % 50 == 0:
            asked[i] = min(asked.get(i, w), w)
    ids, m = np.array([i for i, _ in kept]), np.array([w for _, w in kept], dtype=object)
    out = []
    for q, w in asked.items():
        s = (m * np.array(w, dtype=object)).sum(axis=1)
        best = sorted((-int(x), int(i)) for x, i in zip(s, ids) if i != q)[:k]
        out += [(q, n + 1, i, -x) for n, (x, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("bytes_, each", [(mtree.TREE_BYTES, mtree.EACH), (100 * 13 * 8, 80)])
def test_top_products(spark, monkeypatch, bytes_, each):
    monkeypatch.setattr(mtree, "LEAF", 16)
    monkeypatch.setattr(mtree.Index.__init__, "__defaults__", (bytes_, each))
    rows = odd_vectors()
    df = spark.createDataFrame(rows, VECTORS).repartition(5)
    got = mtree.top_products(df.where("vec_id % 50 = 0"), df)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect())) == plain_top(rows, 5, 256)
    odd = with_names(df)
    assert sorted(map(tuple, mtree.top_products(odd.where("vec_id % 50 = 0"), odd, 3).collect())) == plain_top(rows, 3, 256)


def test_top_products_edges(spark):
    df = spark.createDataFrame(odd_vectors(), VECTORS)
    none = df.where("false")
    assert mtree.top_products(none, df).count() == 0 and mtree.top_products(df, none).count() == 0
    few = spark.createDataFrame([(0, [1.0, 2.0], 1), (1, [1.0, 2.0], 1), (2, [1.0, 2.0], 1), (50, [], 1)], VECTORS)
    assert sorted(map(tuple, mtree.top_products(few.where("vec_id % 50 = 0"), few).collect())) == plain_top([tuple(r) for r in few.collect()], 5, 256, 2)
    blank = spark.createDataFrame([(0, [], 1), (1, [], 1)], VECTORS)
    assert [tuple(r) for r in mtree.top_products(blank.where("vec_id = 0"), blank).collect()] == [(0, 1, 1, 0)]
    rng = np.random.default_rng(2)  # products that floats don't hold
    large = [(i, (rng.normal(size=4) * 1e6).astype(np.float32).tolist(), 1) for i in range(120)]
    df = spark.createDataFrame(large, VECTORS)
    assert sorted(map(tuple, mtree.top_products(df.where("vec_id % 50 = 0"), df).collect())) == plain_top(large, 5, 256, 4)


def test_tree_avoids_distances():
    """On clusters most pages are never read, and of those that are many entries are passed over by stored distances."""
    rng = np.random.default_rng(1)
    v = np.floor(256 * (rng.normal(size=(40, 16))[rng.integers(0, 40, 8000)] + rng.normal(size=(8000, 16)) * 0.02))
    most = float((v * v).sum(axis=1).max())
    route = mtree._lifted(v[:1], most)[0]
    pages = list(mtree._pages(np.arange(8000), v, most, route))
    assert sorted(x for p in pages if p[1] for x in p[2]) == list(range(8000)) and max(len(p[2]) for p in pages) <= mtree.LEAF
    lifted = {p[0]: p for p in pages}
    for p in pages:  # covering radii hold what is below
        for child, vector, radius in [] if p[1] else zip(p[2], mtree._lifted(p[3], most), p[5]):
            below, at = [child], []
            while below:
                c = lifted[below.pop()]
                at, below = (at + list(c[2]), below) if c[1] else (at, below + list(c[2]))
            assert mtree._apart(mtree._lifted(v[at], most), vector[None, :], most).max() <= radius + 1e-9
    tree, q = mtree.Tree(pages, most), v[::400]
    far = np.sqrt((q * q).sum(axis=1) + most - 2 * q @ route[:-1])
    ids, score = tree.search(q, np.arange(0, 8000, 400), np.full(20, mtree.NONE), 5, far)
    for i, own in enumerate(range(0, 8000, 400)):
        s = (v @ q[i]).astype(int)
        assert list(zip(score[i], ids[i])) == [(a, b) for a, b in sorted(((x, j) for j, x in enumerate(s) if j != own), key=lambda t: (-t[0], t[1]))[:5]]
    assert tree.computed < 0.5 * 20 * 8000 and tree.avoided > 0


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def test_automaton():
    rng = np.random.default_rng(4)
    for least in (1, 2, 6):
        words = sorted({"".join(rng.choice(list("abé"), rng.integers(least, 9))) for _ in range(250)})
        forward, back = Automaton(words), sorted(w[::-1] for w in words)
        backward = Automaton(back)
        assert len(forward.next) < sum(map(len, words)) and Automaton([]).one_error("ab", 1) == []
        for w in words:
            m = len(w) // 2
            one = [words[i] for i in forward.one_error(w, m)]
            two = [back[i][::-1] for i in backward.one_error(w[::-1], len(w) - m)]
            assert len(set(one)) == len(one) and len(set(two)) == len(two)
            assert sorted(one + [x for x in two if not x.startswith(w[:m])]) == [x for x in words if near(x, w)]
    long = "a" * 100_000
    assert Automaton([long, long + "a"]).one_error(long, 50_000) == [1]


def plain_words(texts, least, spoil):
    count = Counter()
    for i, t in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if spoil and h % spoil == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += len(run) >= least
    return +count


def plain_groups(count, ratio):
    form = {}
    neighbours = {w: [u for u in count if near(u, w)] for w in count}
    for w, us in neighbours.items():
        best = min(((-count[u], u) for u in us), default=None)
        form[w] = best[1] if best and -best[0] >= ratio * count[w] else None
    out = []
    for w in count:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, count[w], len(neighbours[w]), count[form[w]] if form[w] else None))
    return sorted(out)


@pytest.mark.parametrize("held", [spelling.HELD, 3])
def test_spelling(spark, monkeypatch, held):
    monkeypatch.setattr(spelling, "HELD", held)
    monkeypatch.setattr(spelling, "ASKS", 2)
    monkeypatch.setattr(spelling, "LETTERS_EACH", 2000)
    rng = np.random.default_rng(7)
    stems = ["".join(rng.choice(list("abcÉéß×"), rng.integers(7, 12))) for _ in range(25)] + ["aaaaaaaa", "aaaaaaa", "abababab"]
    texts = [(int(i), " ".join(str(x) for x in rng.choice(stems, 60, p=np.r_[0.5, np.full(27, 0.5 / 27)]))) for i in range(60)]
    texts += [(1, texts[1][1]), (None, "Aaaaaaab aaaaaaab " * 3), (70, None), (71, ""), (72, "ab1cd " * 9), (73, ("q" * 30_000 + " ") * 3), (74, ("q" * 29_999 + " ") * 40), (75, "thinking thinkin thinkin THINKINGK " * 3)]
    df = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(3)
    want = plain_groups(Counter({w: n for w, n in plain_words(texts, 7, 31).items() if n >= 2}), 10)
    got = spelling.spelling_variants(df, spoil=31)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    key = lambda r: r[0]
    assert sorted(map(tuple, got.collect()), key=key) == want
    assert sum(r[1] is not None for r in want) > 20 and any(r[1] and r[1] != r[2] for r in plain_groups(Counter({"abcdefg": 1000, "abcdefgh": 100, "abcdefghi": 10}), 10))
    assert sorted(map(tuple, spelling.spelling_variants(with_names(df), spoil=31).collect()), key=key) == want
    assert spelling.spelling_variants(with_names(df).where("false")).count() == 0


def test_spelling_of_counted_words(spark):
    words = [("abcdefg", 1000), ("abcdefgh", 100), ("abcdefghi", 10), ("abcdefghij", 1), ("ab", 30), ("abc", 3), ("a", 5), ("b", 50), ("", 4), (None, 9), ("ac", 300)]
    df = spark.createDataFrame(words, "word string, n bigint")
    got = {r.word: r for r in spelling.variant_groups(df).collect()}
    assert len(got) == 10 and got["abcdefghij"].root == "abcdefg" and got["abcdefghi"].form == "abcdefgh"
    assert got["ab"].form == "ac" and got["abc"].root == "ac" and got["a"].n_near == 0
    with pytest.raises(ValueError):
        spelling.variant_groups(df, 1)


def plain_codes(rows, scale, width, parts=4, entries=256, rounds=4):
    kept = [(i, w + [0] * (parts * width - len(w)), c) for i, v, c in rows if (w := taken(v, scale)) is not None]
    v = np.array([w for _, w, _ in kept], dtype=np.int64).reshape(len(kept), parts, width)
    first = sorted(range(len(kept)), key=lambda j: (kept[j][0] is None, kept[j][0] or 0, kept[j][1]))[:entries]
    books = [v[first, p] for p in range(parts)]
    near = lambda p: ((v[:, p, None, :] - books[p][None]) ** 2).sum(axis=2)
    for _ in range(rounds):
        for p in range(parts):
            own = near(p).argmin(axis=1)
            books[p] = np.array([v[own == e, p].sum(axis=0) // (own == e).sum() if (own == e).any() else books[p][e] for e in range(len(books[p]))])
    index, error = np.stack([near(p).argmin(axis=1) for p in range(parts)], axis=1), sum(near(p).min(axis=1) for p in range(parts))
    total = defaultdict(int)
    for (_, _, c), e in zip(kept, error):
        total[c] += int(e)
    digest = hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()
    return [(i, "".join(f"{x:02x}" for x in index[j]), int(error[j]), total[c], digest) for j, (i, _, c) in enumerate(kept)]


def test_vector_codes(spark):
    rows = odd_vectors()
    df = spark.createDataFrame(rows, VECTORS).repartition(5)
    got = codes.vector_codes(df)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    want = sorted(plain_codes(rows, 1024, 3), key=str)
    assert sorted(map(tuple, got.collect()), key=str) == want
    assert sorted(map(tuple, codes.vector_codes(with_names(df)).collect()), key=str) == want
    assert codes.vector_codes(df.where("false")).count() == 0
    ragged = [(i, (np.arange(i % 8) * 0.25 - 1).tolist(), None) for i in range(40)]
    assert sorted(map(tuple, codes.vector_codes(spark.createDataFrame(ragged, VECTORS)).collect()), key=str) == sorted(plain_codes(ragged, 1024, 2), key=str)


def test_partial_distances():
    rng = np.random.default_rng(3)
    for width, size, high in ((1, 5, 3), (6, 256, 4), (16, 256, 600), (16, 40, 1 << 28)):
        v, book = rng.integers(-high, high, (3000, width)), rng.integers(-high, high, (size, width))
        index, error, added = codes.nearest(v, book)
        d = ((v[:, None, :] - book[None]) ** 2).sum(axis=2)
        assert (index == d.argmin(axis=1)).all() and (error == d.min(axis=1)).all()
        assert added <= d.size * width
    blobs = rng.normal(size=(64, 16)) * 500
    v = (blobs[rng.integers(0, 64, 4000)] + rng.normal(size=(4000, 16)) * 5).astype(np.int64)
    assert codes.nearest(v, blobs.astype(np.int64))[2] < 0.45 * 4000 * 64 * 16  # most entries are dropped early

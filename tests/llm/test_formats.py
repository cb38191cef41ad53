"""Archives, secrets with checksums, and shards against plain versions."""

import base64
import gzip
import hashlib

import duckdb
import numpy as np
import pytest

from lanternfish.llm import decontaminate, queries, secrets, warc
from lanternfish.llm.batches import text_blocks
from lanternfish.sources.scratch import new_path

FOLDER = "/root/testdata/sf0.01"


@pytest.mark.parametrize("after", ["", " please pay soon", " thanks", " X", ", and", "\n1234", " AB12 CD34 EF56"])
@pytest.mark.parametrize("number", ["GB82 WEST 1234 5698 7654 32", "GB82WEST12345698765432", "DE89 3704 0044 0532 0130 00", "NO93 8601 1117 947", "MT84 MALT 0110 0001 2345 MTLC AST0 01S"])
def test_ibans_end_at_their_length(number, after):
    text = f"my iban: {number}{after}"
    assert [s for s in secrets.scan(text) if s[2] == "iban"] == [(3, 9 + len(number), "iban")]


def test_ibans_that_are_none():
    for text in ("IBAN GB82 WEST 1234 5698 7654 33", "IBAN GB82 WEST 1234 5698 7654 321", "IBAN gb82 west 1234 5698 7654 32", "IBAN ZZ82 WEST 1234 5698 7654 32", "IBAN GB82 WEST 1234 5698 7654"):
        assert not [s for s in secrets.scan(text) if s[2] == "iban"], text


def test_base_kinds_against_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{FOLDER}/documents.parquet'")
    want = {r[0]: r[1:] for r in con.sql(queries.OP8_BASE).fetchall()}
    got = {r.doc_id: (r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in queries.op8_secrets(spark, FOLDER).collect()}
    assert got == want and sum(sum(r[:3]) for r in got.values()) > 20


@pytest.mark.parametrize("version", [1, 2])
def test_a_url_may_look_like_the_first_header(version):
    recs = [{"url": "filedesc://x y", "date": "20200102030405", "mime": "text/html", "block": b"one"}, {"url": "filedesc://z", "date": "20200102030405", "mime": "text/html", "block": b""}, {"url": "http://a", "date": "2020", "mime": "text/plain", "block": b"three"}]
    data = warc.write_arc(recs, version)
    assert [(r["url"], r["block"]) for r in warc.read_arc(data)] == [(r["url"], r["block"]) for r in recs]
    assert [r["block"] for r in warc.read_arc(b"\n\n" + data)] == [r["block"] for r in recs]


def test_archives_are_converted(spark):
    arcs, out = new_path(spark, "arcs").removeprefix("file://"), new_path(spark, "warcs")
    import os

    os.makedirs(arcs + "/deep")
    want = []
    for n in range(6):
        recs = [{"url": f"http://h/{n}/{k}", "date": "2019010203", "mime": "text/html", "block": b"HTTP/1.1 200 OK\r\n\r\n" + bytes([65 + n]) * k} for k in range(5)]
        data = warc.write_arc(recs, 1 + n % 2)
        with open(f"{arcs}/{'deep/' * (n % 2)}{n}.arc", "wb") as f:
            f.write(gzip.compress(data) if n % 3 else data)
        want += [(r["url"], "2019-01-02T03:00:00Z", k, base64.b32encode(hashlib.sha1(bytes([65 + n]) * k).digest()).decode()) for k, r in enumerate(recs)]
    warc.convert_archives(spark, "file://" + arcs, out, per_file=7)
    assert sorted((r.url, r.date, r.payload_bytes, r.payload_digest) for r in warc.warc_records(spark, out).collect()) == sorted(want)


def test_long_pages_have_archives_of_their_own(spark):
    pages = [(i, f"u{i}", chr(97 + i % 5) * (10 if i % 4 else 3000) + str(i // 2)) for i in range(60)] + [(100, None, "z" * 50_000), (None, "n", "z" * 50_000), (101, "e", "")]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string").coalesce(1)
    path = new_path(spark, "warc")
    warc.pages_to_warc(df, path, sizes=((100, 20), (5000, 4), (1 << 62, 1)))
    files = spark.read.format("binaryFile").load(path).collect()
    sizes = sorted(sum(int(f["content-length"]) for f, _ in warc.read_warc(bytes(r.content))) for r in files)
    assert len(files) == 3 + 4 + 2 and sum(s > 20_000 for s in sizes) == 1
    back = {r.page_id: (r.payload_bytes, r.record_type, r.refers_to) for r in warc.warc_records(spark, path).collect()}
    assert len(back) == 63 and back["100"] == (50_000, "response", None) and back[None] == (50_000, "revisit", "100")


def test_suffixes_of_whole_shards():
    """All suffixes in order, with ties of every length, against sorting."""
    rng = np.random.default_rng(1)
    for n in (1, 2, 30, 300):
        for kinds in (1, 2, 3, 50):
            t = rng.integers(1, kinds + 1, n)
            t[n // 2 :] = t[: n - n // 2]
            order = decontaminate.suffix_array(t, 1 << 20)
            assert [list(t[i:]) for i in order] == sorted(list(t[i:]) for i in range(n))


def test_longest_matches_against_a_plain_search():
    rng = np.random.default_rng(2)
    words = [b"w%d" % i for i in range(6)]
    for trial in range(40):
        items = [(str(k), [words[i] for i in rng.integers(0, 6, n)]) for k, n in enumerate((3, 8, 25, 40))]
        text = [words[i] for i in rng.integers(0, 6, 60)] + [b"other"] + items[2][1][:15] + items[3][1]
        block = decontaminate.TestBlock(items, 5)
        row, = decontaminate.scan_shard([b" ".join(text)], iter([block]))
        want = set()
        for name, item in items:
            n = min(5, len(item))
            for p in range(len(text)):
                for q in range(len(item)):
                    if p and q and text[p - 1] == item[q - 1]:
                        continue
                    m = 0
                    while p + m < len(text) and q + m < len(item) and text[p + m] == item[q + m]:
                        m += 1
                    if m >= n:
                        want.add((name, q, p, m))
        assert {(m["item_id"], m["item_word"], m["doc_word"], m["words"]) for m in row[6]} == want
        assert row[5] == max((m for *_, m in want), default=0) and row[0] == len(text)


def test_columns_are_found_as_spark_finds_them(spark):
    from lanternfish.llm import toxicity

    df = spark.createDataFrame([(1, "two three four"), (2, "clean")], "doc_id bigint, Text string")
    bench = spark.createDataFrame([(7, "two three")], "item_id bigint, text string")
    assert [r.doc_id for r in decontaminate.drop_contaminated(df, bench).collect()] == [2]
    labels = spark.createDataFrame([(1, 0)], "doc_id bigint, toxic int")
    assert toxicity.drop_toxic(df, labels).columns == ["doc_id", "Text"]


def test_blocks_of_pages():
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"n": [1, 2, 3], "p": pa.array([b"a" * 10, None, b"\xff\x00"], pa.binary())})
    got = list(text_blocks(iter([batch]), 1, 9))
    assert [t for _, x in got for t in x] == [b"a" * 10, b"", b"\xff\x00"]

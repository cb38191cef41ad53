"""Legacy ARC archives to WARC, and WARC archives as tables."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanternfish.llm.batches import text_blocks
from lanternfish.llm.bloom import bitmap_of, probe, repeated_words, words_for
from lanternfish.llm.store import join_hot, new_path, written

# Header lines of the ARC format, by version, and the WARC record shape.
ARC_FIELDS = {1: ("url", "ip", "date", "mime", "length"), 2: ("url", "ip", "date", "mime", "status", "checksum", "location", "offset", "filename", "length")}
ARC_NAMES = {1: "URL IP-address Archive-date Content-type Archive-length", 2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}
VERSION, END = b"WARC/1.1\r\n", b"\r\n\r\n"
DATE = "20240101000000"
PAGE = "WARC-X-Page-Id"
SMALLEST = 0
#: Payloads of up to so many bytes, and how many of them an archive holds at most: 64 MB, or one longer payload.
SIZES = ((1 << 16, 1000), (1 << 22, 16), (1 << 62, 1))
#: Bytes of payloads, in whole pages, that are converted at once. Memory only.
BLOCK_BYTES = 8 << 20


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def write_arc(records: list[dict], version: int) -> bytes:
    """An ARC archive of dicts with url, date, mime and block; the legacy form this module converts from."""
    body = f"{version} 0 lanternfish\n{ARC_NAMES[version]}\n\n".encode()
    out = [f"filedesc://lanternfish.arc 0.0.0.0 {DATE} text/plain {'200 - - 0 lanternfish.arc ' if version == 2 else ''}{len(body)}\n".encode() + body]
    for r in records:
        head = [r["url"], "0.0.0.0", r["date"], r["mime"]]
        if version == 2:
            head += ["200", "-", "-", str(sum(map(len, out))), "lanternfish.arc"]
        out.append(" ".join([*head, str(len(r["block"]))]).encode() + b"\n" + r["block"] + b"\n")
    return b"".join(out)


def read_arc(data: bytes) -> Iterator[dict]:
    """Records of an ARC archive, gzipped or not. The version line in the first record's block names the
    version, which fixes the header lines' fields; each block has the declared length, whatever is in it.
    Line feeds between records are passed over; URLs may hold spaces, so fields count from the right."""
    data = gunzip(data)
    at, version, first = 0, 1, True
    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        end = data.find(b"\n", at)
        if end < 0:
            raise ValueError(f"a header line without an end at byte {at}")
        line = data[at:end].decode("utf-8", "surrogateescape").rstrip("\r")
        opening, first = first and line.startswith("filedesc://"), False
        if opening:  # a later record may have such a URL
            length = int(line.rsplit(" ", 1)[1])
            version = int(data[end + 1 : end + 1 + length].split(b" ", 1)[0])
            if version not in ARC_FIELDS:
                raise ValueError(f"ARC version {version}")
            at = end + 1 + length
            continue
        names = ARC_FIELDS[version]
        parts = line.rsplit(" ", len(names) - 1)
        if len(parts) != len(names) or not parts[-1].isdigit():
            raise ValueError(f"no version {version} header line at byte {at}: {line[:80]!r}")
        record = dict(zip(names, parts))
        length = int(record["length"])
        if end + 1 + length > len(data):
            raise ValueError(f"a block shorter than declared at byte {at}")
        record["block"] = data[end + 1 : end + 1 + length]
        yield record
        at = end + 1 + length


def gunzip(data: bytes) -> bytes:
    """``data`` as it is, or all members of a gzip file."""
    if data[:2] != b"\x1f\x8b":
        return data
    out = []
    while data:
        z = zlib.decompressobj(31)
        out.append(z.decompress(data) + z.flush())
        data = z.unused_data.lstrip(b"\0")
    return b"".join(out)


def http_parts(block: bytes) -> tuple[bytes, bytes]:
    """(headers with their end, payload) of an HTTP block; all of another block is payload."""
    if block.startswith(b"HTTP/"):
        cut = block.find(END)
        if cut >= 0:
            return block[: cut + 4], block[cut + 4 :]
    return b"", block


def header(head: bytes, name: str) -> str | None:
    for line in head.split(b"\r\n")[1:]:
        k, _, v = line.partition(b":")
        if k.strip().lower() == name.lower().encode():
            return v.strip().decode("utf-8", "surrogateescape")
    return None


def timestamp(date: str) -> str:
    """An ARC date of up to 14 digits as a WARC date; absent parts are the least there are."""
    d = (date if date.isdigit() else DATE)[:14]
    d += "00000101000000"[len(d) :]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(url: str, date: str, page: str, payload_digest: str) -> str:
    """The same for the same record, so that a task that runs again writes the same."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{date} {page} {payload_digest} {url}')}>"


def to_warc(record: dict, refers: tuple[str | None, str | None] | None = None) -> bytes:
    """A WARC record of an ARC record, without the two line ends that follow it. ``refers``: (url, page id)
    of the response whose payload is the same; then it is a revisit, which has the HTTP headers only."""
    head, payload = http_parts(record["block"])
    page = header(head, "X-Page-Id") or ""
    d, date = digest(payload), timestamp(record["date"])
    kind = "revisit" if refers else "response" if head else "resource"
    block = head if refers else record["block"]
    fields = [("WARC-Type", kind), ("WARC-Record-ID", record_id(record["url"], date, page, d)), ("WARC-Target-URI", record["url"].replace("\r", "").replace("\n", "")), ("WARC-Date", date),
              ("WARC-Payload-Digest", f"sha1:{d}"), ("WARC-Block-Digest", f"sha1:{digest(block)}"), (PAGE, page)]
    if refers:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(refers[0] or "", date, refers[1] or "", d)),
                   ("WARC-Refers-To-Target-URI", refers[0] or ""), ("WARC-Refers-To-Date", date), ("WARC-X-Refers-To-Page-Id", refers[1] or "")]
    fields += [("Content-Type", "application/http; msgtype=response" if head else record["mime"]), ("Content-Length", str(len(block)))]
    return VERSION + "".join(f"{k}: {v}\r\n" for k, v in fields).encode("utf-8", "surrogateescape") + b"\r\n" + block


def read_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of each record, by the declared lengths."""
    data, at = gunzip(data), 0
    while at < len(data):
        if data[at : at + 2] == b"\r\n":
            at += 2
            continue
        end = data.find(END, at)
        if end < 0 or data[at : at + 5] != b"WARC/":
            raise ValueError(f"no WARC record at byte {at}")
        fields = {k.strip().lower().decode(): v.strip().decode("utf-8", "surrogateescape") for k, _, v in (line.partition(b":") for line in data[at:end].split(b"\r\n")[1:])}
        length = int(fields["content-length"])
        yield fields, data[end + 4 : end + 4 + length]
        at = end + 4 + length


def convert_arc(data: bytes) -> Iterator[bytes]:
    """WARC records of an ARC archive that stands alone (no revisits)."""
    for record in read_arc(data):
        yield to_warc(record)


def archived(records: DataFrame, path: str, per_file: int) -> None:
    """Write ``records`` (value: bytes of a WARC record) as gzipped archives of ``per_file`` records at most. Spark's
    text writer commits the files, so a task that is lost or runs twice leaves one copy. It puts bytes as they
    are, and the two line ends that close a record part the rows."""
    out = records.select(F.col("value").cast("string")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip")
    out.option("zlib.compress.level", "BEST_SPEED").option("maxRecordsPerFile", per_file).mode("append").text(path)


def convert_archives(spark: SparkSession, arc_path: str, path: str, per_file: int = 1000) -> None:
    """Write the records of the ARC archives under ``arc_path``, gzipped or not, as WARC archives under ``path``.
    An archive is read as one value, so it has two gigabytes at most; its records leave it one by one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                for record in convert_arc(data.as_buffer().to_pybytes()):
                    yield pa.RecordBatch.from_arrays([pa.array([record], pa.binary())], names=["value"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(arc_path).select("content")
    archived(files.mapInArrow(run, "value binary"), path, per_file)


def pages_to_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", smallest: int = SMALLEST, sizes: tuple = SIZES) -> None:
    """Write each page as a record of gzipped WARC archives under ``path``.

    Pages come as ARC archives, versions 1 and 2 in turn, one for each batch, and are converted. Of pages
    whose payloads are equal and have at least ``smallest`` bytes, that of the largest id is a response
    and the others revisit it. Two Bloom passes pick payloads that may repeat; other pages don't shuffle.
    Archives hold as many records as ``sizes`` says for payloads of their size, so that very long pages don't make
    large archives. A null html is an empty payload, a null url an empty one; null ids are smallest, and their
    records have none; of ties in id the greatest url is the response. Rows that repeat id, url and html are
    responses together. Other columns are not read, whatever they are called; an empty table gives no archive.
    """
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    ready = pages.select(F.col(id_col).alias("__id"), F.coalesce(F.col(url_col), F.lit("")).alias("__url"), payload.alias("__payload"),
                         F.unhex(F.sha1(payload)).alias("__key"), F.octet_length(payload).alias("__n"))
    narrow = written(ready.select("__key", "__id", "__url", "__n"), "warc-keys")
    large = narrow.where(F.col("__n") >= smallest)
    words = words_for(large.count())
    bitmap = bitmap_of(repeated_words(large.select(F.xxhash64("__key").alias("__h")), words))
    best = written(probe(large, F.xxhash64("__key"), bitmap, words).where("__maybe").groupBy("__key").agg(
        F.count(F.lit(1)).alias("__size"), F.max(F.struct(F.col("__id").alias("id"), F.col("__url").alias("url"))).alias("__best")).where("__size > 1"), "warc-copies")
    looked = probe(ready, F.xxhash64("__key"), bitmap, words)
    none = F.lit(None).cast("string")
    alone = looked.where("not __maybe").select("__id", "__url", "__payload", "__n", none.alias("__to_url"), none.alias("__to_id"), F.lit(False).alias("__revisit"))
    again = (F.col("__size") > 1) & (F.col("__n") >= smallest) & ~F.struct(F.col("__id").alias("id"), F.col("__url").alias("url")).eqNullSafe(F.col("__best"))
    met = join_hot(looked.where("__maybe"), best, "__key", F.col("__id")).select(
        "__id", "__url", "__payload", "__n", F.col("__best.url").alias("__to_url"), F.col("__best.id").cast("string").alias("__to_id"), F.coalesce(again, F.lit(False)).alias("__revisit"))

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = 0
        for batch, payloads in text_blocks(batches, 2, BLOCK_BYTES):
            records, rows = [], batch.select([n for n in batch.schema.names if n != "__payload"]).to_pylist()
            for r, html in zip(rows, payloads):
                page = "" if r["__id"] is None else r["__id"]
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(html)}\r\nX-Page-Id: {page}\r\n\r\n".encode()
                records.append({"url": r["__url"].replace("\n", "").replace("\r", ""), "date": DATE, "mime": "text/html", "block": head + html})
            turn += 1
            arc = write_arc(records, 1 + turn % 2)
            del records, payloads
            out = [to_warc(x, (r["__to_url"], r["__to_id"]) if r["__revisit"] else None) for r, x in zip(rows, read_arc(arc))]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    lines, longest, least = alone.unionByName(met), narrow.agg(F.max("__n")).first()[0], 0
    for most, per_file in sizes:
        if longest is not None and longest >= least:
            mine = lines if longest <= most and not least else lines.where(F.col("__n").between(least, most))
            archived(mine.mapInArrow(convert, "value binary"), path, per_file)
        least = most + 1


def warc_records(spark, path: str) -> DataFrame:
    """(record_id, record_type, url, date, page_id, payload_bytes, payload_digest, refers_to, payload) of
    each record of the archives under ``path``. A response's digest and length are those of the bytes
    read, which must agree with the record's own; a revisit's are declared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                rows = []
                for f, block in read_warc(data.as_py()):
                    head, payload = http_parts(block)
                    said = f.get("warc-payload-digest", "").removeprefix("sha1:")
                    revisit = f["warc-type"] == "revisit"
                    if not revisit and said and digest(payload) != said:
                        raise ValueError(f"{f['warc-record-id']}: the payload has another digest")
                    n = int(header(head, "Content-Length") or 0) if revisit else len(payload)
                    rows.append((f["warc-record-id"], f["warc-type"], f.get("warc-target-uri"), f.get("warc-date"), f.get(PAGE.lower()) or None, n, said or digest(payload), (f.get("warc-x-refers-to-page-id") or None) if revisit else None, None if revisit else payload))
                kinds = [*[pa.string()] * 5, pa.int64(), pa.string(), pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * 9, kinds)],
                                                 names=["record_id", "record_type", "url", "date", "page_id", "payload_bytes", "payload_digest", "refers_to", "payload"])

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, "record_id string, record_type string, url string, date string, page_id string, payload_bytes bigint, payload_digest string, refers_to string, payload binary")


def warc_digests(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, payload_bytes, payload_digest, record_type, refers_to) of each page, read back from archives
    that :func:`pages_to_warc` wrote in the shared folder; its cases are the same. No pages give no rows."""
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    pages_to_warc(pages, path, id_col, url_col, html_col)
    kind = pages.schema[id_col].dataType
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath):
        return spark.createDataFrame([], f"`{id_col}` {kind.simpleString()}, payload_bytes bigint, payload_digest string, record_type string, refers_to {kind.simpleString()}")
    return warc_records(spark, path).select(F.col("page_id").cast(kind).alias(id_col), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))

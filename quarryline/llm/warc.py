"""WARC archives: writing pages, and reading records back by boundary chains.

The writer is a DataFrame plan: records are built by SQL functions and saved
through Spark's own text writer, whose line separator is the blank line that
ends a record.  Pages with equal payloads are written once; the others become
``revisit`` records that name the page they repeat.

The reader must not take the magic ``WARC/1.`` inside a payload for a record.
A task unpacks a file and emits every candidate with the offset of its
successor (offset + header + Content-Length + 4), range by range.  Within a
range pointers are jumped locally, so that each candidate points beyond its
range; the remaining pointers, one hop per range, are jumped in log2(ranges)
joins from the start of each file.  Only records on that chain remain, and only
payloads that a walk from the file's start meets are hashed, so records inside
payloads cost no more than their headers.  A file must fit into a worker's
memory (``binaryFile`` refuses 2 GB); the writer's files follow the partitions
of its shuffle, about ``PARTITION_BYTES`` of payload each.

Defined results: null html is an empty payload; a null url is written as
``urn:unknown``; pages with a null id are responses; a repeated row is written
again (of equal payloads, every row with the largest id is a response); ties
of payloads go to the largest id; urls, headers and payloads may have any
length; in a damaged file the records before the damage remain, or with
``strict`` an error is raised; further columns of ``pages``, whatever their
names, are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import materialize, new_path
from .common import table

MAGIC = b"WARC/1."
DATE = "2024-01-01T00:00:00Z"
END = "\r\n\r\n"
#: Bytes of a file that are one range of the scan.
RANGE_BYTES = 4 << 20
#: Records of a file at most, so that files stay of moderate size.
RECORDS_PER_FILE = 5_000
#: Bytes of payload in a partition of the writer's shuffle, about.
PARTITION_BYTES = 64 << 20
#: Equal payloads are spread over so many keys in the join that marks revisits.
SALTS = 16

CANDIDATES = "file string, range long, off long, next long, exit long, size long, record_type string, record_id string, refers_to string, payload_bytes long, payload_digest string"
_B32_FROM, _B32_TO = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of SHA-1: 20 bits (5 hexadecimal digits) are 4 base32 digits."""
    digest = F.sha1(payload)
    return F.translate(F.concat(*(F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8))), _B32_FROM, _B32_TO)


def _id(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">"))


def write_pages(pages: DataFrame, path: str, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", compression: str = "gzip", records_per_file: int = RECORDS_PER_FILE) -> None:
    """Writes one record per page; payloads of at least ``min_bytes`` that repeat are revisits of the page with the largest id."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", base32_sha1(F.col("html").cast("binary"))).withColumn("bytes", F.octet_length("html").cast("long"))
    repeated = rows.where(F.col("bytes") >= min_bytes).groupBy("digest", "bytes").agg(F.max("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    salted = repeated.withColumn("salt", F.explode(F.array(*(F.lit(i) for i in range(SALTS)))))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    n = -(-(pages.agg(F.sum(F.octet_length(html_col)).alias("n")).first()["n"] or 0) // PARTITION_BYTES)
    if n > int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        rows = rows.repartition(n, "digest", "bytes", "salt")
    rows = rows.join(salted, ["digest", "bytes", "salt"], "left")
    revisit = F.col("first_id").isNotNull() & F.col("page_id").isNotNull() & (F.col("page_id") != F.col("first_id"))
    body = F.when(revisit, F.lit("HTTP/1.1 200 OK" + END)).otherwise(F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(END), F.col("html")))
    url = F.regexp_replace(F.coalesce(F.col("url"), F.lit("urn:unknown")), r"[\x00-\x20\x7F]", "%20")
    refers = F.when(revisit, F.concat(F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "), _id(F.col("first_id")), F.lit("\r\n"))).otherwise(F.lit(""))
    record = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit("\r\nWARC-Record-ID: "), _id(F.col("page_id")), F.lit(f"\r\nWARC-Date: {DATE}\r\nWARC-Target-URI: "), url,
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("digest"), F.lit("\r\nX-Payload-Length: "), F.col("bytes").cast("string"), F.lit("\r\n"), refers,
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length("body").cast("string"), F.lit(END), F.col("body"),
    )
    rows.withColumn("body", body).select(record.alias("value")).write.option("lineSep", END).option("maxRecordsPerFile", records_per_file).option("compression", compression).text(path)


def _unpack(content: bytes) -> bytes:
    """Undoes gzip, of one or more members."""
    if content[:2] != b"\x1f\x8b":
        return content
    parts = []
    while content:
        one = zlib.decompressobj(31)
        parts.append(one.decompress(content))
        content = one.unused_data
    return b"".join(parts)


_FIELD = re.compile(rb"^([A-Za-z0-9-]+):(.*)$", re.MULTILINE)


def _fields(block: bytes) -> dict[bytes, tuple[bytes, int]]:
    """Of each field in lines its last value and where it stands."""
    return {m[1].lower(): (m[2].strip(b" \t"), m.start()) for m in _FIELD.finditer(block)}


def scan(data: bytes, range_bytes: int = RANGE_BYTES) -> dict[str, list]:
    """All candidates of a file: every place with the magic and a header that tells a length. Payloads are hashed where a walk from the start passes."""
    out: dict[str, list] = {k: [] for k in ("range", "off", "next", "exit", "record_type", "record_id", "refers_to", "payload_bytes", "payload_digest")}
    at = data.find(MAGIC)
    first = stop = -1
    due = 0  # where the next record of the walk begins
    told_fields: dict[bytes, tuple[bytes, int]] = {}
    while at >= 0:
        if at > stop:
            # candidates before the same blank line share one look at its lines, so long headers cost no more than their bytes
            first, stop = at, data.find(b"\r\n\r\n", at)
            if stop < 0:
                break
            told_fields = _fields(data[at:stop].replace(b"\r\n", b" \n"))
        fields = {k: v for k, (v, place) in told_fields.items() if first + place > at}
        if (n := fields.get(b"content-length", b"")).isdigit() and len(n) < 16:
            begin, end = stop + 4, stop + 4 + int(n)
            if end <= len(data):
                head = data.find(b"\r\n\r\n", begin, end)
                kind = fields.get(b"warc-type", b"").decode("latin-1")
                told = fields.get(b"x-payload-length", b"")
                if at != due:
                    size, digest = None, None
                elif kind == "revisit" and told.isdigit():
                    size, digest = int(told), fields.get(b"warc-payload-digest", b"").partition(b":")[2].decode("latin-1")
                else:
                    payload = memoryview(data)[head + 4 if head >= 0 else begin : end]
                    size, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
                due = end + 4 if at == due else due
                for k, v in (("range", at // range_bytes), ("off", at), ("next", end + 4), ("record_type", kind), ("record_id", fields.get(b"warc-record-id", b"").decode("latin-1")), ("refers_to", fields[b"warc-refers-to"].decode("latin-1") if b"warc-refers-to" in fields else None), ("payload_bytes", size), ("payload_digest", digest)):
                    out[k].append(v)
        at = data.find(MAGIC, at + 1)
    off, nxt = np.array(out["off"], np.int64), np.array(out["next"], np.int64)
    if len(off):
        place = np.minimum(np.searchsorted(off, nxt), len(off) - 1)
        near = (off[place] == nxt) & (off[place] // range_bytes == off // range_bytes)
        jump = np.where(near, place, np.arange(len(off)))
        while not np.array_equal(further := jump[jump], jump):
            jump = further
        out["exit"] = nxt[jump].tolist()
    return out


def candidates(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES, strict: bool = False) -> DataFrame:
    """``CANDIDATES`` of all files below a path; with ``strict`` a file that does not begin with one is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split(" ")[0] for x in CANDIDATES.split(", ")]
        kinds = [pa.int64() if x.endswith(" long") else pa.string() for x in CANDIDATES.split(", ")]
        for batch in batches:
            for i in range(batch.num_rows):
                data = _unpack(batch.column("content")[i].as_py())
                found = scan(data, range_bytes)
                n = len(found["off"])
                if strict and data and found["off"][:1] != [0]:
                    raise ValueError(f"no record at the start of {batch.column('path')[i].as_py()}")
                found |= {"file": [batch.column("path")[i].as_py()] * n, "size": [len(data)] * n}
                yield pa.RecordBatch.from_arrays([pa.array(found[k], t) for k, t in zip(names, kinds, strict=True)], names)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, CANDIDATES)


def _walk(rows: pa.Table) -> pa.Table:
    """Of one range's candidates those on the chain from its entry."""
    off, nxt, entry = (rows.column(k).to_numpy() for k in ("off", "next", "entry"))
    kept = np.zeros(len(off), bool)
    place = {int(o): i for i, o in enumerate(off)}
    i = int(np.flatnonzero(entry)[0]) if entry.any() else None
    while i is not None:
        kept[i] = True
        i = place.get(int(nxt[i]))
    return rows.filter(pa.array(kept)).drop_columns(["entry"])


def read_records(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES, strict: bool = False) -> DataFrame:
    """``CANDIDATES`` that are records: those that the chain from their file's start reaches; with ``strict`` it must reach the file's end."""
    found = materialize(candidates(spark, path, range_bytes, strict), "candidates")
    hops = found.agg((F.max("range") + 1).alias("n")).first()["n"] or 1  # ranges of the longest file
    reached = found.where("off = 0").select("file", "off")
    # only candidates that another one jumps to (or a file's start) can be met on the way: about one for each range
    met = found.select("file", F.col("exit").alias("off")).distinct().union(reached)
    jump = materialize(found.where("exit < size").select("file", "off", F.col("exit").alias("to")).join(met, ["file", "off"], "left_semi"), "jump")
    steps = 1
    while steps < hops:
        reached = materialize(reached.union(reached.join(jump, ["file", "off"]).select("file", F.col("to").alias("off"))).distinct(), "reached")
        steps *= 2
        if steps < hops:
            far = jump.select("file", F.col("off").alias("to"), F.col("to").alias("far"))
            jump = materialize(jump.join(far, ["file", "to"]).select("file", "off", F.col("far").alias("to")), "jump")
    if strict:
        ends = found.select("file", "off", "exit", "size").join(reached, ["file", "off"]).groupBy("file").agg(F.max("exit").alias("end"), F.max("size").alias("size"))
        if broken := ends.where("end < size").first():
            raise ValueError(f"records end at byte {broken['end']} of {broken['size']} of {broken['file']}")
    marked = found.join(reached.withColumn("entry", F.lit(True)), ["file", "off"], "left").withColumn("entry", F.coalesce("entry", F.lit(False)))
    order = [x.split(" ")[0] for x in CANDIDATES.split(", ")]
    return marked.select(*order, "entry").groupBy("file", "range").applyInArrow(_walk, CANDIDATES)


def op7_warc_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write_pages(table(spark, sf_dir, "pages"), path)
    number = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")
    return read_records(spark, path, strict=True).select(number(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", number(F.col("refers_to")).alias("refers_to"))

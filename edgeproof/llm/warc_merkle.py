"""WARC: Merkle fixity audit.

Records of a WARC file, in offset order, are the leaves of a tree; a node hashes its children's offset ranges and hashes in order. Two
replicas compare their roots, and only below mismatching nodes the next level, down to the records that are changed, missing or
extra. Everything is DataFrame work: a record is hashed where it lies, and only hashes, offsets and lengths move.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._arrow import written

#: Children of a node, and records of a file when pages are dealt to files.
FANOUT = 16
FILE_RECORDS = 4096


def record(url: Column, body: Column) -> Column:
    """The text of a response record; a null address or body is empty."""
    url, body = F.coalesce(url, F.lit("")), F.coalesce(body, F.lit(""))
    head = F.concat(F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: "), url, F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    return F.concat(head, body, F.lit("\r\n\r\n"))


def dealt(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", damage: Column | None = None) -> DataFrame:
    """(file, seq, id, offset, length, sha256) of each page's record, and damaged_sha256, that of the record with its first byte lost where ``damage`` (on the columns key and id) holds.

    Pages go to files of about FILE_RECORDS records by a hash of id and address, whatever repeats; a file is in order of id (null first) and hash.
    """
    n = max(1, -(-pages.count() // FILE_RECORDS))
    key = F.conv(F.substring(F.md5(F.concat_ws("|", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.coalesce(F.col(url_col), F.lit("")), F.sha2(record(F.col(url_col), F.col(body_col)), 256))), 1, 8), 16, 10).cast("bigint")
    text = record(F.col(url_col), F.col(body_col))
    rows = pages.select(F.col(id_col).alias("id"), text.alias("t"), key.alias("key"))
    bad = F.when(damage, F.sha2(F.concat(F.lit("#"), F.expr("substr(t, 2)")), 256)) if damage is not None else F.lit(None).cast("string")
    rows = rows.select("id", (F.col("key") % n).alias("file"), F.octet_length("t").cast("bigint").alias("length"), F.sha2("t", 256).alias("sha256"), bad.alias("damaged_sha256"))
    by = Window.partitionBy("file").orderBy(F.col("id").asc_nulls_first(), "sha256")
    rows = rows.withColumn("seq", F.row_number().over(by).cast("bigint") - 1)
    offset = F.sum("length").over(Window.partitionBy("file").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)) - F.col("length")
    return rows.select("file", "seq", "id", offset.alias("offset"), "length", "sha256", "damaged_sha256")


def tree(records: DataFrame, levels: int, fanout: int = FANOUT) -> list[DataFrame]:
    """Levels of nodes (file, node, start, end, hash), the records first and the roots last. A node has at most ``fanout`` children."""
    out = [records.select("file", F.col("seq").alias("node"), F.col("offset").alias("start"), (F.col("offset") + F.col("length")).alias("end"), F.col("sha256").alias("hash"))]
    for _ in range(levels):
        child = F.sort_array(F.collect_list(F.struct("node", "start", "end", "hash")))
        up = out[-1].groupBy("file", F.expr(f"node div {fanout}").alias("up")).agg(child.alias("c"), F.min("start").alias("start"), F.max("end").alias("end"))
        line = F.transform("c", lambda c: F.concat_ws(":", c["start"].cast("string"), c["end"].cast("string"), c["hash"]))
        out.append(up.select("file", F.col("up").alias("node"), "start", "end", F.sha2(F.concat_ws("\n", line), 256).alias("hash")))
    return out


def depth(records: DataFrame, fanout: int = FANOUT) -> int:
    """Levels above the records of the longest file."""
    most, levels = (records.agg(F.max("seq")).first()[0] or 0) + 1, 1
    while fanout**levels < most:
        levels += 1
    return levels


def mismatches(ours: DataFrame, theirs: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """(file, seq, status) of records that are changed, missing (in theirs) or extra, found from the roots down mismatching branches only. Both: (file, seq, offset, length, sha256), seq counting from 0."""
    levels = max(depth(ours, fanout), depth(theirs, fanout))
    a, b = tree(ours, levels, fanout), tree(theirs, levels, fanout)
    bad: DataFrame | None = None
    for x, y in zip(reversed(a), reversed(b), strict=True):
        if bad is not None:
            up = bad.select("file", F.col("node").alias("up"))
            x, y = (d.withColumn("up", F.expr(f"node div {fanout}")).join(up, ["file", "up"], "left_semi").drop("up") for d in (x, y))
        x = x.select("file", "node", F.struct("start", "end", "hash").alias("ours"))
        y = y.select("file", "node", F.struct("start", "end", "hash").alias("theirs"))
        bad = x.join(y, ["file", "node"], "full_outer").where(~F.col("ours").eqNullSafe(F.col("theirs")))
        bad = written(bad.select("file", "node", F.when(F.col("theirs").isNull(), "missing").when(F.col("ours").isNull(), "extra").otherwise("changed").alias("status")), "branches")
    return bad.withColumnRenamed("node", "seq")


def audit(records: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """``records`` of ``dealt`` with corrupt: whether the audit finds the record changed in the replica that has damaged_sha256 where that is set."""
    replica = records.withColumn("sha256", F.coalesce("damaged_sha256", "sha256"))
    found = mismatches(records, replica, fanout).select("file", "seq", F.lit(True).alias("corrupt"))
    return records.join(found, ["file", "seq"], "left").withColumn("corrupt", F.coalesce("corrupt", F.lit(False)))


# ---- files ----


def parse_warc(data: bytes) -> Iterator[tuple[int, int, str, str]]:
    """(offset, length, type, sha256) of each record of a WARC file, plain or of gzip members (offsets and lengths are those of the stored bytes, hashes of the record's own). Stops at a damaged one, which it gives with type "damaged"."""
    at = 0
    while at < len(data):
        if data[at : at + 2] == b"\x1f\x8b":
            z = zlib.decompressobj(31)
            try:
                own = z.decompress(data[at:]) + z.flush()
            except zlib.error:
                own = b""
            size = len(data) - at - len(z.unused_data)
            whole = z.eof and own.startswith(b"WARC/")
        else:
            end = data.find(b"\r\n\r\n", at)
            n = re.search(rb"(?im)^content-length:[ \t]*([0-9]+)[ \t]*\r?$", data[at : max(end, at)])
            size = end + 8 + int(n[1]) - at if n else 0
            own = data[at : at + size]
            whole = bool(n) and own.startswith(b"WARC/") and len(own) == size and own.endswith(b"\r\n\r\n")
        if not whole:
            yield at, len(data) - at, "damaged", hashlib.sha256(data[at:]).hexdigest()
            return
        kind = re.search(rb"(?im)^warc-type:[ \t]*([^\r\n]*)", own[: own.find(b"\r\n\r\n")])
        yield at, size, kind[1].decode("latin-1").strip() if kind else "", hashlib.sha256(own).hexdigest()
        at += size


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(file, seq, offset, length, type, sha256) of all records of WARC files; file is the name without its folder, so replicas match. A file is one row and is read whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                rows = [(name.rsplit("/", 1)[-1], k, *r) for k, r in enumerate(parse_warc(data))]
                cols = list(zip(*rows, strict=True)) if rows else [()] * 6
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["file", "seq", "offset", "length", "type", "sha256"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "file string, seq long, offset long, length long, type string, sha256 string")


def warc_bytes(records: list[str], packed: bool = False) -> bytes:
    """A WARC file of these records; packed: each a gzip member."""
    return b"".join(gzip.compress(r.encode(), mtime=0) if packed else r.encode() for r in records)


def op8_warc_merkle(spark, sf_dir: str) -> DataFrame:
    """The record of every page, and whether the audit finds it corrupt in a replica in which one of 50 records lost its first byte."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    records = written(dealt(pages, damage=F.expr("key div 65536 % 50 = 0")), "records")
    got = audit(records)
    return got.select(F.col("id").alias("page_id"), "file", "seq", "offset", "length", F.col("sha256").alias("record_sha256"), "corrupt")


OP8_SQL = r"""
WITH t AS (SELECT page_id, url, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS t FROM pages),
h AS (SELECT page_id, url, CAST(strlen(t) AS BIGINT) AS length, sha256(t) AS s FROM t),
k AS (SELECT *, CAST('0x' || substr(md5(coalesce(CAST(page_id AS VARCHAR), '') || '|' || coalesce(url, '') || '|' || s), 1, 8) AS BIGINT) AS key, greatest(1, (count(*) OVER () + 4095) // 4096) AS n FROM h)
SELECT page_id, CAST(key % n AS BIGINT) AS file, row_number() OVER w - 1 AS seq, CAST(sum(length) OVER w AS BIGINT) - length AS "offset", length, s AS record_sha256, key // 65536 % 50 = 0 AS corrupt
FROM k WINDOW w AS (PARTITION BY key % n ORDER BY page_id NULLS FIRST, s ROWS UNBOUNDED PRECEDING)
"""

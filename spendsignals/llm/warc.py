"""WARC: pages written as archives through a chunked record table and read back record by record.

A payload becomes rows (record number, chunk number, data) of bounded size, each written as one WARC
record: the first chunk as ``response``, the others as ``continuation`` segments. Equal payloads are
stored once; the others become ``revisit`` records. Reading streams records of bounded size; the payload
digest of a record in several chunks is fed chunk by chunk, so no whole record is ever held.

Archives are written and read by Spark's text source, so they may lie in any store Spark reaches. The
reader's line separator is the four bytes that end a record plus the next record's version line. A payload
that holds such bytes is cut inside them, so they cannot be mistaken for the end of a record.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_path, text_or_empty, written

CHUNK_CHARS = 262_144          # at most 1 MiB in UTF-8
REVISIT_BYTES = 1000
BATCH_CHUNKS = 64              # chunks in an Arrow batch
VERSION = "WARC/1.0\r\n"
SEPARATOR = "\r\n\r\n" + VERSION
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"


def chunk_table(pages: DataFrame, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """``record, page_id, url, payload_bytes, payload_digest, chunk, chunks, data`` (string), one row per chunk.

    ``record`` numbers the rows of ``pages``; the table is written once, so the numbers hold. Null html is
    an empty payload with one empty chunk. Cuts fall between code points."""
    html = text_or_empty("html")
    page = pages.select("page_id", "url", html.alias("_html"), F.octet_length(html).cast("long").alias("payload_bytes"),
                        F.sha1(html.cast("binary")).alias("payload_digest"),
                        F.monotonically_increasing_id().alias("record"))
    # cut inside every version line first, then by length; a chunk must not begin with one either, as the head before it ends in two line breaks
    parts = F.split("_html", "(?<=\r\n\r\nWARC)(?=/1[.]0)")
    starts = lambda s: F.sequence(F.lit(0), F.greatest(F.ceil(F.length(s) / chunk_chars) - 1, F.lit(0)).cast("int"))
    cut = F.flatten(F.transform(parts, lambda s: F.transform(
        starts(s), lambda k: F.substring(s, k * chunk_chars + 1, F.lit(chunk_chars)))))
    cut = F.flatten(F.transform(cut, lambda s: F.when(F.startswith(s, F.lit("WARC/1.0")), F.array(F.lit("W"), F.substring(s, F.lit(2), F.length(s)))).otherwise(F.array(s))))
    chunks = F.when((F.length("_html") <= chunk_chars) & (F.instr("_html", "WARC/1.0") == 0), F.array("_html")).otherwise(cut)
    return written(page.withColumn("_chunks", chunks).select(
        "record", "page_id", "url", "payload_bytes", "payload_digest", F.size("_chunks").alias("chunks"),
        F.posexplode("_chunks").alias("chunk", "data")), "warc-chunks")


def assign_types(chunks: DataFrame, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """``chunks`` with ``refers`` and ``refers_record``: null for a response, else the page_id and record that
    a revisit points to. Among equal payloads of at least ``revisit_bytes`` bytes the largest
    (page_id, record) is the response; a null page_id is smaller than any."""
    heads = chunks.where((F.col("chunk") == 0) & (F.col("payload_bytes") >= revisit_bytes))
    chosen = heads.groupBy("payload_digest", "payload_bytes").agg(
        F.max(F.struct("page_id", "record")).alias("_r"), F.count("*").alias("_n")).where("_n > 1")
    joined = chunks.join(chosen, ["payload_digest", "payload_bytes"], "left")
    revisit = F.col("_r").isNotNull() & (F.col("_r.record") != F.col("record"))
    return joined.select(*chunks.columns, F.when(revisit, F.col("_r.page_id")).alias("refers"),
                         F.when(revisit, F.col("_r.record")).alias("refers_record"))


def _uid(record: Column) -> Column:
    """A stable record identifier: the record number as a UUID."""
    h = F.lpad(F.lower(F.hex(record)), 32, "0")
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, s, n) for s, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def write_archives(pages: DataFrame, path: str, chunk_chars: int = CHUNK_CHARS, revisit_bytes: int = REVISIT_BYTES,
                   date: str = "1970-01-01T00:00:00Z") -> None:
    """Write one WARC record per row of ``pages`` (``page_id, url, html``; null html: empty payload), further
    chunks as ``continuation`` records, as gzip files under ``path``. Line breaks and other control
    characters in a url are percent-encoded. Extra columns are ignored; an empty table writes no record."""
    t = assign_types(chunk_table(pages, chunk_chars), revisit_bytes)
    head = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(name + ": "), value.cast("string"), F.lit("\r\n"))).otherwise("")
    revisit, first = F.col("refers_record").isNotNull(), F.col("chunk") == 0
    block = F.when(revisit, F.lit(HTTP_HEAD)).when(first, F.concat(F.lit(HTTP_HEAD), "data")).otherwise(F.col("data"))
    segmented = F.col("chunks") > 1
    uri = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    own = F.when(first, _uid(F.col("record"))).otherwise(F.concat(F.regexp_replace(_uid(F.col("record")), ">", ""), F.lit("#"), F.col("chunk"), F.lit(">")))
    record = F.concat(
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").when(first, "response").otherwise("continuation"), F.lit("\r\n")),
        head("WARC-Record-ID", own), F.lit(f"WARC-Date: {date}\r\n"), head("WARC-Target-URI", uri),
        F.lit("Content-Type: application/http;msgtype=response\r\n"),
        head("WARC-Page-ID", F.col("page_id")), head("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "payload_digest")),
        head("WARC-Refers-To", F.when(revisit, _uid(F.col("refers_record")))), head("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        head("WARC-Segment-Number", F.when(segmented & ~revisit, F.col("chunk") + 1)),
        head("WARC-Segment-Origin-ID", F.when(~first, _uid(F.col("record")))),
        head("WARC-Segment-Total-Length", F.when(segmented & ~revisit & (F.col("chunk") == F.col("chunks") - 1), F.col("payload_bytes") + len(HTTP_HEAD))),
        head("Content-Length", F.octet_length(block)), F.lit("\r\n"), block)
    (t.where(first | ~revisit).select(F.concat(F.lit(VERSION), record).alias("value"))
     .write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path))


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """The archives' records: ``record`` (identifier of the whole record), ``chunk, type, page_id, refers_to``
    (record identifier), ``digest, segmented, data`` (payload part). Records are read one at a time."""
    # a file's first record still has its version line, its last one the line breaks that end it
    raw = spark.read.option("lineSep", SEPARATOR).text(path).where(F.length("value") > 0).select(
        F.when(F.startswith("value", F.lit(VERSION)), F.substring(F.col("value"), F.lit(len(VERSION) + 1), F.length("value"))).otherwise(F.col("value")).alias("value"))
    cut = F.instr("value", "\r\n\r\n")
    raw = raw.select(F.concat(F.lit("\r\n"), F.substring(F.col("value"), F.lit(1), cut - 1), F.lit("\r\n")).alias("_head"),
                     F.substring(F.col("value"), cut + 4, F.length("value")).alias("_block"))
    field = lambda name: F.nullif(F.regexp_extract("_head", f"\r\n{name}: ([^\r]*)\r\n", 1), F.lit(""))
    ended = F.octet_length("_block") == field("Content-Length").cast("long") + 4
    raw = raw.withColumn("_block", F.when(ended & F.endswith("_block", F.lit("\r\n\r\n")), F.substring(F.col("_block"), F.lit(1), F.length("_block") - 4)).otherwise(F.col("_block")))
    kind, origin = field("WARC-Type"), field("WARC-Segment-Origin-ID")
    return raw.select(
        F.coalesce(origin, field("WARC-Record-ID")).alias("record"),
        (F.coalesce(field("WARC-Segment-Number").cast("int"), F.lit(1)) - 1).alias("chunk"), kind.alias("type"),
        field("WARC-Page-ID").cast("long").alias("page_id"), field("WARC-Refers-To").alias("refers_to"),
        F.regexp_replace(field("WARC-Payload-Digest"), "^sha1:", "").alias("digest"),
        field("WARC-Segment-Number").isNotNull().alias("segmented"),
        (field("Content-Length").cast("long") == F.octet_length("_block")).alias("whole"),
        F.when(kind == "continuation", F.col("_block")).otherwise(F.substring(F.col("_block"), F.lit(len(HTTP_HEAD) + 1), F.length("_block"))).alias("data"))


def _incremental_digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Batches sorted by record and chunk -> bytes and SHA-1 of each record's payload; state is one hasher."""
    record, page, sha, size = None, None, None, 0
    for pdf in batches:
        done = []
        for r, p, data in zip(pdf["record"], pdf["page_id"], pdf["data"], strict=True):
            if r != record:
                if record is not None:
                    done.append((record, page, size, sha.hexdigest()))
                record, page, sha, size = r, None, hashlib.sha1(), 0
            raw = data.encode()
            sha.update(raw)
            size += len(raw)
            page = p if not pd.isna(p) else page
        yield pd.DataFrame(done, columns=["record", "page_id", "payload_bytes", "payload_digest"]).astype({"page_id": "Int64"})
    if record is not None:
        yield pd.DataFrame([(record, page, size, sha.hexdigest())], columns=["record", "page_id", "payload_bytes", "payload_digest"]).astype({"page_id": "Int64"})


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per page record of the archives: ``page_id, payload_bytes, payload_digest, record_type, refers_to``.

    Length and digest are taken from the payload read, never from a header; a revisit takes them from the
    record it refers to. A damaged record (length other than its Content-Length) raises an error."""
    got = read_chunks(spark, path).withColumn(
        "data", F.when(F.col("whole"), F.col("data")).otherwise(F.raise_error(F.concat(F.lit("damaged record "), F.col("record")))))
    single = got.where((F.col("type") == "response") & ~F.col("segmented")).select(
        "record", "page_id", F.octet_length("data").cast("long").alias("payload_bytes"), F.sha1(F.col("data").cast("binary")).alias("payload_digest"))
    several = (got.where(F.col("segmented")).select("record", "chunk", "page_id", "data")
               .repartition("record").sortWithinPartitions("record", "chunk")
               .mapInPandas(_incremental_digests, "record string, page_id long, payload_bytes long, payload_digest string"))
    responses = written(single.unionByName(several), "warc-responses", BATCH_CHUNKS)
    revisits = got.where(F.col("type") == "revisit").select("page_id", F.col("refers_to").alias("record"), "digest")
    out = responses.select("page_id", "payload_bytes", "payload_digest", F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"))
    pointed = revisits.join(responses.withColumnRenamed("page_id", "_to"), "record")
    return out.unionByName(pointed.select("page_id", "payload_bytes", "payload_digest", F.lit("revisit").alias("record_type"), F.col("_to").alias("refers_to")))


def round_trip(pages: DataFrame, chunk_chars: int = CHUNK_CHARS, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """Write ``pages`` into archives in the shared folder and read them back (see ``read_archives``)."""
    spark, path = pages.sparkSession, shared_path(pages.sparkSession, "warc")
    write_archives(pages, path, chunk_chars, revisit_bytes)
    return read_archives(spark, path)

"""Sharding: contiguous shards of near equal byte size from global prefix sums.

The documents get one global order (digest of the text, then doc_id, so equal texts lie side by side).
``repartitionByRange`` deals that order out, so partition k holds what comes before partition k + 1; a
large group of copies is split by its doc_ids. Per-partition totals give each partition its byte and row
offset, a running sum inside the partition does the rest, and the total is cut at equal targets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import text_or_empty, written

ROW_BYTES = 8


def shard_by_bytes(docs: DataFrame, shards: int = 24) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, size, text_crc32, shard, slot``.

    ``size`` is the UTF-8 length of the text plus 8 (null text: 8), ``text_crc32`` the unsigned CRC-32 of
    the UTF-8 bytes (null: of nothing, 0). A row goes to the shard in which the middle of its byte range
    falls, so a shard differs from its target by less than one row. ``slot`` counts a shard's rows from 0
    without gaps. Only ``doc_id`` and ``text`` are read, whatever else ``docs`` holds.

    Null doc_ids are kept and come first among equal texts. Repeated rows are separate rows. Texts that
    are longer than a target fill the shard they fall into and may leave others empty. An empty table
    gives an empty result.
    """
    size = F.octet_length(text_or_empty()).cast("long") + F.lit(ROW_BYTES)
    rows = docs.select("doc_id", size.alias("size"), F.crc32(text_or_empty().cast("binary")).alias("text_crc32"),
                       F.md5(text_or_empty().cast("binary")).alias("_order"))
    # the partition number is the place in the global order; written once, so every reader sees the same
    dealt = written(rows.repartitionByRange("_order", "doc_id").withColumn("_part", F.spark_partition_id()), "shard-rows")
    # one row per partition
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy("_part").agg(F.sum("size").alias("_bytes"), F.count("*").alias("_rows"))
    offsets = totals.select("_part", F.coalesce(F.sum("_bytes").over(before), F.lit(0)).alias("_byte0"),
                            F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_row0"))
    total = F.broadcast(dealt.agg(F.sum("size").alias("_total")))   # one row
    inside = Window.partitionBy("_part").orderBy("_order", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    placed = (dealt.withColumn("_end", F.sum("size").over(inside))
              .withColumn("_row", F.row_number().over(Window.partitionBy("_part").orderBy("_order", "doc_id")) - 1)
              .join(F.broadcast(offsets), "_part").join(total)
              .withColumn("_middle", F.col("_byte0") + F.col("_end") - F.col("size") / 2)
              .withColumn("shard", F.least(F.floor(F.col("_middle") * shards / F.col("_total")), F.lit(shards - 1)).cast("int"))
              .select("doc_id", "size", "text_crc32", "shard", (F.col("_row0") + F.col("_row")).alias("_row")))
    placed = written(placed, "shard-placed")
    first = placed.groupBy("shard").agg(F.min("_row").alias("_first"))   # one row per shard
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("_row") - F.col("_first")).alias("slot"))

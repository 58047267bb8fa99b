"""Helpers shared by the operators: tables kept in the shared folder, words, row order."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

#: The white space that separates words: space and \x09-\x0D. Fixed by the word rule of the operators.
WORD_SPACE = "\\x20\\x09-\\x0D"


ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
TEXT_ROWS, NARROW_ROWS = 256, 10_000


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that the cluster shares (``spark.checkpoint.dir``)."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, batch_rows: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: cuts the lineage, pins values
    such as row numbers, survives lost executors, and lets later steps read only the columns they need.
    ``batch_rows`` holds for this write: rows of an Arrow batch between Spark and Python."""
    spark, path = df.sparkSession, shared_path(df.sparkSession, name)
    before = spark.conf.get(ARROW_ROWS)
    if batch_rows:
        spark.conf.set(ARROW_ROWS, str(batch_rows))
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if batch_rows:
            spark.conf.set(ARROW_ROWS, before)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, name: str) -> DataFrame:
    """``df`` with a row key ``_row``, pinned by writing it: decisions can be joined back row by row."""
    return written(df.withColumn("_row", F.monotonically_increasing_id()), name)


def bounded_batches(df: DataFrame) -> DataFrame:
    """Before whole texts go to Python: lower the session's Arrow batches to ``TEXT_ROWS`` rows, as Spark counts
    rows, not bytes, and a batch of very long texts would not fit a worker. A lower setting stays."""
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(ARROW_ROWS)) <= TEXT_ROWS:
        conf.set(ARROW_ROWS, str(TEXT_ROWS))
    return df


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def byte_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the text in UTF-8 with A-Z lower-cased (``bytes`` methods treat
    only ASCII letters and exactly this white space)."""
    return text.encode().lower().split() if text else []


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))

"""From raw documents to packed training sequences, stage by stage.

Every stage is a function ``(spark, docs, sf_dir) -> DataFrame``; its result is written as Parquet and read
again as the next stage's ``docs``. All but the last return the columns of ``documents``. Every row is judged
by its own text, also where a doc_id is null or repeats.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendsignals.llm.common import numbered, read_table, written
from spendsignals.llm.decontam import without_leaks
from spendsignals.llm.langid import identify, train
from spendsignals.llm.minhash import near_duplicates
from spendsignals.llm.packing import pack_documents
from spendsignals.llm.pii import redact
from spendsignals.llm.queries import tokenizer_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language identification (operator 4): ``lang`` becomes the predicted language; documents that are
    rejected (no letters, or no language clearly ahead) go."""
    columns = docs.columns
    judged = identify(docs, train(docs)).where("accepted")
    return judged.withColumn("lang", F.col("lang_pred")).select(*columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-duplicates (operator 5, five-word shingles): one row of each group stays, that of the least doc_id
    (null ids last, then the least row key)."""
    rows = numbered(docs, "dedup-rows")
    groups = near_duplicates(rows.select(F.col("_row").alias("doc_id"), "text"), width=5).select(F.col("doc_id").alias("_row"), "component_id")
    least = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row")).alias("_least")
    kept = rows.select("_row", "doc_id").join(groups, "_row").groupBy("component_id").agg(least).select("_least._row")
    return rows.join(kept, "_row", "left_semi").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination (operator 7): documents that hold a benchmark passage go."""
    return without_leaks(docs, read_table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data (operator 6) is replaced by its kind; every document stays."""
    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing (operator 2) of all that is left: pieces with their ids and their place in a sequence."""
    return pack_documents(docs, tokenizer_path())


STAGES = [("language", language), ("near_dedup", near_dedup), ("decontamination", decontamination),
          ("personal_data", personal_data), ("packing", packing)]

#: SQL cannot tokenize or compress; ``tests/llm`` holds the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

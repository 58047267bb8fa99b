"""Transaction sources and sinks (S1-S4, S7) and the adapter from the driver's tables.

``transactions_from_events`` turns ``events`` joined to ``customer`` into the 10-column transaction
table of the reference, plus a deterministic score ``impulse_prob`` that stands in for a trained
model in tests (FIXTURES.md sections 2-3).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.timeline import DEFAULT_ROWS_PER_CHUNK, Running, with_timeline

TXN_SCHEMA = T.StructType([
    T.StructField("transaction_id", T.LongType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("timestamp", T.TimestampNTZType()),
    T.StructField("hour", T.IntegerType()),
    T.StructField("is_weekend", T.IntegerType()),
    T.StructField("transaction_amount", T.DoubleType()),
    T.StructField("balance_after", T.DoubleType()),
    T.StructField("monthly_salary", T.DoubleType()),
    T.StructField("merchant_category", T.StringType()),
    T.StructField("impulse_label", T.IntegerType()),
])

# Fixed values of the test-data adapter (FIXTURES.md section 2): category cycle by event_id % 11,
# the adapter's own risk per category, salary rule, impulse rule.
ADAPTER_CATEGORIES = ["Entertainment", "Fashion", "Food", "Electronics", "Travel", "Utilities",
                      "Healthcare", "Education", "Groceries", "Others", "Gifts"]
ADAPTER_RISK = [3, 3, 2, 2, 2, 0, 0, 0, 1, 1, 1]
ADAPTER_BASE_SALARY = 1500.0
ADAPTER_SALARY_PER_BALANCE = 0.3
ADAPTER_CUTOFF = 82
ADAPTER_NOISE_WEIGHT = 0.4


CSV_TS_FORMAT = "yyyy-MM-dd HH:mm:ss.SSSSSS"
CSV_TS_FORMAT_READ = "yyyy-MM-dd HH:mm:ss[.SSSSSS]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_transactions(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Read a transaction table with an explicit schema (CSV needs no inference pass)."""
    reader = spark.read.schema(TXN_SCHEMA)
    if fmt == "csv":
        return reader.option("header", True).option("timestampNTZFormat", CSV_TS_FORMAT_READ).csv(path)
    return reader.format(fmt).load(path)


def save_table(df: DataFrame, path: str, fmt: str = "parquet", sort_keys=None) -> None:
    """Write a table; rows sorted within files by the given keys (no global sort)."""
    out = df.sortWithinPartitions(*sort_keys) if sort_keys else df
    w = out.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        w = w.option("header", True).option("timestampNTZFormat", CSV_TS_FORMAT)
    w.save(path)


def load_table(spark: SparkSession, path: str, fmt: str = "parquet", schema=None) -> DataFrame:
    """Reload a written table."""
    reader = spark.read.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True)
    return reader.load(path)


def to_records(df: DataFrame, col: str = "record") -> DataFrame:
    """One JSON object per row, built on the executors."""
    return df.select(F.to_json(F.struct(*df.columns)).alias(col))


def transactions_from_events(spark: SparkSession, sf_dir: str, with_score: bool = True,
                             rows_per_chunk: int = DEFAULT_ROWS_PER_CHUNK, hot=None) -> DataFrame:
    """FIXTURES adapter: events x customer -> transactions (+ deterministic ``impulse_prob``)."""
    ev = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "value", "props")
    cu = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    idx = (F.col("event_id") % 11).cast("int") + 1
    b = (ev.join(cu, ev.user_id == cu.c_custkey)
         .select(
             F.col("event_id").alias("transaction_id"),
             F.col("user_id"),
             F.col("ts").alias("timestamp"),
             F.hour("ts").cast("int").alias("hour"),
             (F.weekday("ts") >= 5).cast("int").alias("is_weekend"),
             F.col("value").alias("transaction_amount"),
             (F.lit(ADAPTER_BASE_SALARY) + F.abs("c_acctbal") * ADAPTER_SALARY_PER_BALANCE).alias("monthly_salary"),
             F.element_at(F.array(*[F.lit(c) for c in ADAPTER_CATEGORIES]), idx).alias("merchant_category"),
             F.element_at(F.array(*[F.lit(r) for r in ADAPTER_RISK]), idx).alias("_risk"),
             F.get_json_object("props", "$.k").cast("int").alias("_k"),
             F.round(F.col("value") * 100).cast("long").alias("_cents"),
         ))
    b = with_timeline(b, [Running("_cum_cents", F.col("_cents"), inclusive=True)],
                      rows_per_chunk=rows_per_chunk, hot=hot)
    late = (F.col("hour") < 5) | (F.col("hour") >= 21)
    pts = (F.col("_risk") * 10 + F.when(late, 20).otherwise(0) + F.col("is_weekend") * 10
           + F.least(F.col("transaction_amount") / 4, F.lit(40.0)))
    out = b.withColumn("_pts", pts).select(
        "transaction_id", "user_id", "timestamp", "hour", "is_weekend", "transaction_amount",
        F.greatest(F.col("monthly_salary") - F.col("_cum_cents") / F.lit(100.0), F.lit(0.0)).cast("double")
        .alias("balance_after"),
        "monthly_salary", "merchant_category",
        F.when(F.col("_pts") + F.col("_k") * ADAPTER_NOISE_WEIGHT > ADAPTER_CUTOFF, 1).otherwise(0)
        .alias("impulse_label"),
        F.round(1 / (1 + F.exp(-(F.col("_pts") + 20 - ADAPTER_CUTOFF) / 12)), 6).alias("impulse_prob"),
    )
    return out if with_score else out.drop("impulse_prob")


# DuckDB statement of the same adapter (FIXTURES.md section 2), used as the head of every oracle.
TXN_CTE = """txn AS (
 WITH b AS (
  SELECT event_id AS transaction_id, e.user_id, ts AS "timestamp",
         CAST(hour(ts) AS INT) AS hour,
         CASE WHEN isodow(ts) >= 6 THEN 1 ELSE 0 END AS is_weekend,
         value AS transaction_amount,
         1500.0 + abs(c_acctbal) * 0.3 AS monthly_salary,
         list_extract(['Entertainment','Fashion','Food','Electronics','Travel','Utilities',
           'Healthcare','Education','Groceries','Others','Gifts'], CAST(event_id % 11 AS INT) + 1) AS merchant_category,
         list_extract([3,3,2,2,2,0,0,0,1,1,1], CAST(event_id % 11 AS INT) + 1) AS risk,
         CAST(json_extract_string(props,'$.k') AS INT) AS k,
         sum(CAST(round(value*100) AS BIGINT)) OVER (PARTITION BY e.user_id
             ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS cum_cents
  FROM events e JOIN customer c ON e.user_id = c.c_custkey),
 s AS (SELECT *, risk*10 + CASE WHEN hour < 5 OR hour >= 21 THEN 20 ELSE 0 END
              + 10*is_weekend + least(transaction_amount/4, 40) AS pts FROM b)
 SELECT transaction_id, user_id, "timestamp", hour, is_weekend, transaction_amount,
        greatest(monthly_salary - cum_cents/100.0, 0.0) AS balance_after,
        monthly_salary, merchant_category,
        CASE WHEN pts + k*0.4 > 82 THEN 1 ELSE 0 END AS impulse_label,
        round(1/(1+exp(-(pts + 20 - 82)/12)), 6) AS impulse_prob
 FROM s)"""

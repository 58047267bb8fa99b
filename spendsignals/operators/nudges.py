"""Alerts, savings and nudge messages (reference step 10): A12-A16, A22, J5-J7, O3, O4, P23-P26, P28, P31, S7."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns as C

DEFAULT_SIGNAL = "pred_impulse_rate"
# Message library: one row per dominant signal (our own wording).
NUDGES = [
    ("late_night_rate", "Night-time spending", "Many of your purchases happen late at night.",
     "Keep a 12-hour pause on non-essential buys made after 9 pm.", "NIGHT"),
    ("weekend_rate", "Weekend spending peaks", "Your spending rises at weekends.",
     "Set a weekend budget on Friday and track it in the app.", "WEEKEND"),
    ("mean_spend_zscore", "Unusual purchase sizes", "Some purchases are far above your usual amount.",
     "Wait a day before any purchase bigger than your typical one.", "BURST"),
    ("balance_stress_rate", "Balance running low", "You often spend while your balance is low.",
     "Move a safety amount to savings on payday.", "STRESS"),
    ("mean_category_risk", "Tempting categories", "Your spending leans to categories linked with impulse buys.",
     "Unsubscribe from shop newsletters in these categories.", "CATEGORY"),
    ("pred_impulse_rate", "Frequent impulse buys", "Impulse purchases are a regular part of your spending.",
     "Write a shopping list and buy only what is on it.", "HABIT"),
    ("mean_salary_ratio", "Large share of income", "Single purchases take a big share of your income.",
     "Cap single purchases at a fixed share of your monthly income.", "SALARY"),
    ("impulse_prob_std", "Uneven spending", "Your spending swings between calm and intense periods.",
     "Spread larger purchases over a planned calendar.", "VARIABLE"),
    ("recency_weighted_prob", "Risk rising lately", "Your recent purchases look more impulsive than before.",
     "Review your last ten purchases and mark the ones you regret.", "ESCALATING"),
    ("mean_drawdown", "Balance drained quickly", "Purchases use up a large part of your balance.",
     "Keep a minimum balance alert switched on.", "DRAWDOWN"),
]
NUDGE_SCHEMA = T.StructType([T.StructField(n, T.StringType()) for n in
                             ("signal", "nudge_title", "nudge_message", "nudge_tip", "nudge_icon")])
# Urgency label per alert level (unknown -> TIP).
URGENCY = {"Immediate Alert": "ACTION REQUIRED", "Warning": "HEADS UP", "Watch": "FYI", "Safe": "TIP"}
URGENCY_DEFAULT = "TIP"


def potential_savings(scored: DataFrame) -> DataFrame:
    """Per user, the amount spent on transactions predicted impulsive."""
    return scored.groupBy("user_id").agg(
        F.sum(F.col("transaction_amount") * F.col("impulse_pred")).alias("potential_savings"))


def attach_savings(profile: DataFrame, savings: DataFrame) -> DataFrame:
    """J5."""
    return profile.join(savings, "user_id", "left")


SIGNAL_COLS = ["dominant_signal", "potential_savings", "late_night_rate", "balance_stress_rate",
               "mean_spend_zscore", "pred_impulse_rate"]


def attach_signals(at_risk: DataFrame, profile: DataFrame) -> DataFrame:
    """J6."""
    return at_risk.join(profile.select("user_id", *[c for c in SIGNAL_COLS if c in profile.columns]),
                        "user_id", "left")


def nudge_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(NUDGES, NUDGE_SCHEMA)


def urgency(alert) -> F.Column:
    """P24."""
    m = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in URGENCY.items()))
    return F.coalesce(m[alert], F.lit(URGENCY_DEFAULT))


def savings_line(savings) -> F.Column:
    """P25: sentence with a thousands separator (half-even rounding), empty when nothing to save."""
    return F.when(savings > 0, F.concat(F.lit("Redirecting those impulse purchases could have saved about Rs."),
                                        F.format_number(savings, 0), F.lit(" this period."))).otherwise(F.lit(""))


def with_nudges(at_risk_full: DataFrame) -> DataFrame:
    """P23 + P24 + P25 + P26 (+ J7 as added columns): nudge template by dominant signal (default
    ``pred_impulse_rate``), urgency, savings sentence and the full message."""
    lib = nudge_table(at_risk_full.sparkSession)
    known = F.col("dominant_signal").isin([n[0] for n in NUDGES])
    df = at_risk_full.withColumn("_signal", F.when(known, F.col("dominant_signal")).otherwise(F.lit(DEFAULT_SIGNAL)))
    df = df.join(F.broadcast(lib.withColumnRenamed("signal", "_signal")), "_signal", "left").drop("_signal")
    df = df.withColumns({
        "savings_line": savings_line(F.coalesce(F.col("potential_savings"), F.lit(0.0))),
        "urgency": urgency(F.col("alert_level")),
    })
    msg = F.concat(F.lit("["), F.col("urgency"), F.lit("] "), F.col("nudge_title"), F.lit("\n"),
                   F.col("nudge_message"), F.lit("\n"), F.col("savings_line"), F.lit("\nWhat to do: "),
                   F.col("nudge_tip"))
    return df.withColumn("full_nudge", F.btrim(msg, F.lit(" \n\t\r")))


def alert_summary(at_risk: DataFrame) -> DataFrame:
    """Users per alert level with the notified (not Safe) and Safe totals."""
    tot = at_risk.agg(F.count_if(F.col("alert_level") != "Safe").alias("notified_users"),
                      F.count_if(F.col("alert_level") == "Safe").alias("safe_users"))
    return (at_risk.groupBy("alert_level").agg(F.count(F.lit(1)).alias("user_count"))
            .crossJoin(F.broadcast(tot))
            .withColumn("alert_order", C.level_order(F.col("alert_level"), C.ALERT_ORDER)))


def tier_alert_matrix(at_risk: DataFrame) -> DataFrame:
    """Risk tier x alert level counts, every level a column, zeros filled."""
    return (at_risk.groupBy("risk_tier").pivot("alert_level", C.ALERT_ORDER).count().na.fill(0)
            .withColumn("tier_order", C.level_order(F.col("risk_tier"), C.TIER_ORDER)))


def savings_by_tier(profile: DataFrame) -> DataFrame:
    """A15."""
    return profile.groupBy("risk_tier").agg(F.avg("potential_savings").alias("avg_potential_savings"))


def distribution(df: DataFrame, col: str, out: str = "user_count") -> DataFrame:
    """A16."""
    return df.groupBy(col).agg(F.count(F.lit(1)).alias(out))


def top_k(df: DataFrame, col: str, k: int, largest: bool = True, by_abs: bool = False,
          tiebreak: str | None = None) -> DataFrame:
    """O3: k rows with the largest (or smallest / largest absolute) values; a limit is the feature."""
    key = F.abs(F.col(col)) if by_abs else F.col(col)
    order = [key.desc() if largest else key.asc()]
    if tiebreak:
        order.append(F.col(tiebreak).asc())
    return df.orderBy(*order).limit(k)


def anonymise(top: DataFrame, col: str = "risk_score", label: str = "display_name") -> DataFrame:
    """``User n`` by rank, applied to an already limited top-k table."""
    w = Window.orderBy(F.col(col).desc(), F.col("user_id"))
    return top.withColumn(label, F.concat(F.lit("User "), F.row_number().over(w).cast("string")))


def relabel(signal) -> F.Column:
    """snake_case signal -> display text."""
    return F.initcap(F.replace(signal, F.lit("_"), F.lit(" ")))


def report_kpis(profile: DataFrame, at_risk: DataFrame, scored: DataFrame, metrics: DataFrame) -> DataFrame:
    """One-row report figures (all computed, none hard-coded)."""
    u = profile.agg(F.count(F.lit(1)).alias("users"),
                    F.count_if(F.col("risk_tier") == "Critical").alias("critical_users"))
    level = F.col("alert_level")
    a = at_risk.agg(F.count_if(level != "Safe").alias("alerts"), *[
        F.count_if(level == name).alias(name.lower().replace(" ", "_") + "_users") for name in C.ALERT_ORDER])
    t = scored.agg(F.count(F.lit(1)).alias("transactions"))
    m = metrics.agg(F.max("roc_auc").alias("best_roc_auc"), F.max("f1").alias("best_f1"), F.max("mcc").alias("best_mcc"))
    return u.crossJoin(a).crossJoin(t).crossJoin(m)

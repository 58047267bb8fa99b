"""User segmentation helpers (reference step 8): A10, A11, A17, A23, J8, P21, P22.

The k-means model itself lives in ``plans.models``; this module profiles any ``cluster`` column.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stats import population_stats

# The ten user signals used for clustering, dominant signals and nudges, in the
# reference's order (the first one wins a tie), and the persona name of each dominant signal.
CLUSTER_FEATURES = ["pred_impulse_rate", "mean_spend_zscore", "late_night_rate", "weekend_rate",
                    "mean_category_risk", "mean_salary_ratio", "balance_stress_rate", "impulse_prob_std",
                    "mean_drawdown", "recency_weighted_prob"]
PERSONA_MAP = {
    "late_night_rate": "The Night Owl Splurger",
    "weekend_rate": "The Weekend Binge Buyer",
    "mean_spend_zscore": "The Burst Spender",
    "balance_stress_rate": "The Financially Stressed Impulser",
    "mean_category_risk": "The Hedonic Category Shopper",
    "pred_impulse_rate": "The Habitual Impulser",
    "mean_salary_ratio": "The Salary Burner",
    "impulse_prob_std": "The Unpredictable Splurger",
    "recency_weighted_prob": "The Escalating Risk User",
    "mean_drawdown": "The Balance Drainer",
}


def dominant(zcols: dict[str, Column]) -> Column:
    """Name of the largest |z| (NULLs skipped); the earliest column wins ties."""
    items = [F.when(z.isNotNull(), F.struct((-F.abs(z)).alias("k"), F.lit(i).alias("i"), F.lit(name).alias("n")))
             for i, (name, z) in enumerate(zcols.items())]
    return F.array_min(F.array_compact(F.array(*items)))["n"]


def with_population(df: DataFrame, stats: DataFrame) -> DataFrame:
    """Every row x the one-row population statistics (broadcast)."""
    return df.crossJoin(F.broadcast(stats))


def dominant_signal(profile: DataFrame, cols=None, out: str = "dominant_signal") -> DataFrame:
    """P22 per user: z against the population mean / sample std (zero std -> 1)."""
    cols = cols or CLUSTER_FEATURES
    pop = population_stats(profile, cols)
    j = with_population(profile, pop)
    z = {c: (F.col(c) - F.col(f"{c}__mean")) / F.col(f"{c}__std") for c in cols}
    return j.withColumn(out, dominant(z)).drop(*pop.columns)


def cluster_profile(profile: DataFrame, cols=None) -> DataFrame:
    """A10: per cluster the raw means, mean risk score, size and the z-profile of the means against
    the population (NULL features count as 0 in the population statistics)."""
    cols = cols or CLUSTER_FEATURES
    filled = profile.select(*[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in cols])
    pop = population_stats(filled, cols)
    means = profile.groupBy("cluster").agg(*[F.avg(c).alias(c) for c in cols],
                                           F.avg("risk_score").alias("risk_score"),
                                           F.count(F.lit(1)).alias("user_count"))
    j = with_population(means, pop)
    return j.select("cluster", *cols, "risk_score", "user_count",
                    *[((F.col(c) - F.col(f"{c}__mean")) / F.col(f"{c}__std")).alias(f"z_{c}") for c in cols])


def persona_map_col(signal: Column, cluster: Column) -> Column:
    m = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in PERSONA_MAP.items()))
    return F.coalesce(m[signal], F.concat(F.lit("Cluster "), cluster.cast("string")))


def assign_persona(profile: DataFrame, cols=None) -> DataFrame:
    """Persona of a user = name of its cluster's dominant z signal (fallback ``Cluster n``).
    The cluster table has one row per cluster and is broadcast."""
    cols = cols or CLUSTER_FEATURES
    cp = cluster_profile(profile, cols)
    sig = dominant({c: F.col(f"z_{c}") for c in cols})
    personas = cp.select("cluster", persona_map_col(sig, F.col("cluster")).alias("persona"))
    return profile.join(F.broadcast(personas), "cluster", "left")


def persona_summary(profile: DataFrame) -> DataFrame:
    """A11."""
    return profile.groupBy("cluster", "persona").agg(
        F.count("user_id").alias("user_count"), F.avg("risk_score").alias("avg_risk_score"),
        F.avg("raw_impulse_rate").alias("avg_impulse_rate"))


def cluster_summary(profile: DataFrame) -> DataFrame:
    """Size, persona (constant within a cluster), mean risk score and mean true rate."""
    return profile.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("user_count"), F.min("persona").alias("persona"),
        F.avg("risk_score").alias("avg_risk_score"), F.avg("raw_impulse_rate").alias("avg_impulse_rate"))

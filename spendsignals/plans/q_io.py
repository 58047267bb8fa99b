"""Queries for materialising and reloading tables (S2-S4, O1), ordering (O2), ranks (W12), F2, A22."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from ..operators import evaluation as X
from ..operators import explain as E
from ..operators import nudges as NU
from ..operators import stats as S
from ..session import ensure_checkpoint_dir
from ..sources.transactions import load_table, save_table
from . import inputs as I
from .catalog import register
from .q_core import _ENG_DOUBLES, rsql
from .q_models import asql
from .q_next import nsql


def _path(spark, name):
    return os.path.join(ensure_checkpoint_dir(spark), "tables", f"{name}-{uuid.uuid4().hex[:12]}")


@register("s02_save_engineered", rsql("SELECT * FROM eng", ("eng",), _ENG_DOUBLES))
def s02(spark, sf):
    """S2 + O1 + S4: write the engineered table as parquet in the shared folder, rows sorted by
    (user, time) inside each file (no global sort), and read it back."""
    path = _path(spark, "engineered")
    save_table(I.eng(spark, sf), path, sort_keys=["user_id", "timestamp", "transaction_id"])
    return load_table(spark, path)


@register("s03_write_results", nsql("SELECT * FROM atrisk", ["next_impulse_prob", "risk_score", "raw_impulse_rate"]))
def s03(spark, sf):
    """S3 + S4: write a result table (the at-risk list) and reload it."""
    path = _path(spark, "at_risk")
    save_table(I.at_risk(spark, sf), path)
    return load_table(spark, path)


@register("s04_csv_roundtrip", rsql("SELECT transaction_id, user_id, \"timestamp\", hour, is_weekend, transaction_amount, "
                                    "balance_after, monthly_salary, merchant_category, impulse_label FROM txn", (),
                                    ["transaction_amount", "balance_after", "monthly_salary"]))
def s04(spark, sf):
    """S1 + S3 + S4 with CSV: write the transaction table as CSV, read it back with the explicit schema."""
    from ..sources.transactions import TXN_SCHEMA, read_transactions
    path = _path(spark, "txn_csv")
    t = I.txn(spark, sf).select(*[f.name for f in TXN_SCHEMA.fields])
    save_table(t, path, fmt="csv")
    return read_transactions(spark, path, "csv")


@register("o02_order_by", rsql(
    "SELECT merchant_category, count(*) AS n, avg(impulse_label) AS impulse_rate FROM txn GROUP BY merchant_category "
    "ORDER BY impulse_rate DESC, merchant_category", (), ["impulse_rate"]))
def o02(spark, sf):
    """O2: result ordered by a metric with a unique tie-break."""
    r = S.rate_by(I.txn(spark, sf), "merchant_category").select("merchant_category", "n", "impulse_rate")
    return r.orderBy(F.col("impulse_rate").desc(), "merchant_category")


@register("w12_ordinal_rank", asql(
    "SELECT model, feature, mean_abs_value, CAST(row_number() OVER (PARTITION BY model ORDER BY mean_abs_value DESC, "
    "feature) AS INT) AS rank FROM mabs", ["mean_abs_value"]))
def w12(spark, sf):
    """Ordinal rank of features by mean |attribution| (ties by name)."""
    return E.ordinal_ranks(E.mean_abs_attribution(E.centered_attribution(I.eng(spark, sf))), "mean_abs_value", "rank")


@register("f02_drop_missing", nsql("SELECT transaction_id, user_id, next_impulse FROM nxd"))
def f02(spark, sf):
    """rows without a next transaction (NULL target) dropped."""
    return I.next_labelled(spark, sf).select("transaction_id", "user_id", "next_impulse")


_KPI_SQL = nsql("""SELECT users, critical_users, alerts, immediate_alert_users, warning_users, watch_users, safe_users, transactions, best_roc_auc,
 2 * tp / (2 * tp + fp + fn) AS best_f1,
 (tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)) AS best_mcc FROM
 (SELECT count(*) AS users, count(*) FILTER (WHERE risk_tier = 'Critical') AS critical_users FROM seg),
 (SELECT count(*) FILTER (WHERE alert_level <> 'Safe') AS alerts,
         count(*) FILTER (WHERE alert_level = 'Immediate Alert') AS immediate_alert_users,
         count(*) FILTER (WHERE alert_level = 'Warning') AS warning_users, count(*) FILTER (WHERE alert_level = 'Watch') AS watch_users,
         count(*) FILTER (WHERE alert_level = 'Safe') AS safe_users FROM atrisk),
 (SELECT CAST(count(*) FILTER (WHERE impulse_label = 1 AND impulse_prob >= 0.7) AS DOUBLE) AS tp,
         CAST(count(*) FILTER (WHERE impulse_label = 0 AND impulse_prob >= 0.7) AS DOUBLE) AS fp,
         CAST(count(*) FILTER (WHERE impulse_label = 1 AND impulse_prob < 0.7) AS DOUBLE) AS fn,
         CAST(count(*) FILTER (WHERE impulse_label = 0 AND impulse_prob < 0.7) AS DOUBLE) AS tn FROM scored),
 (SELECT count(*) AS transactions FROM scored),
 (SELECT sum(CASE WHEN impulse_label = 1 THEN r ELSE 0 END) AS rp, count(*) FILTER (WHERE impulse_label = 1) AS P,
         count(*) FILTER (WHERE impulse_label = 0) AS N,
         (rp - P * (P + 1) / 2.0) / (P * N) AS best_roc_auc
  FROM (SELECT impulse_label, rank() OVER (ORDER BY impulse_prob) + (count(*) OVER (PARTITION BY impulse_prob) - 1) / 2.0 AS r
        FROM scored))""", ["best_roc_auc", "best_f1", "best_mcc"])


@register("a22_report_kpis", _KPI_SQL)
def a22(spark, sf):
    """One-row report figures, all computed: users, critical users, users per alert, transactions, best AUC, F1, MCC."""
    c = I.Ctx(spark, sf, shared=True)
    s = c.scored.select("transaction_id", F.lit("deterministic").alias("model"),
                        F.col("impulse_label").alias("label"), F.col("impulse_prob").alias("prob"), F.col("impulse_pred").alias("pred"))
    return NU.report_kpis(c.segmented, c.at_risk, c.scored, X.compare_models(s))

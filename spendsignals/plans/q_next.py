"""Queries for segmentation stand-ins, next-transaction features, alerts and nudges (milestone 5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import nexttxn as NX
from ..operators import nudges as NU
from ..operators import segments as SG
from ..operators import stats as S
from . import inputs as I
from .catalog import register
from .oracle_sql import with_ctes

CF = SG.CLUSTER_FEATURES


def _argmax(zs: dict[str, str]) -> str:
    items = ", ".join(f"struct_pack(k := -abs({z}), i := {i}, n := '{name}')" for i, (name, z) in enumerate(zs.items()))
    return f"list_sort([{items}])[1].n"


_persona_case = "CASE dom " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SG.PERSONA_MAP.items()) + " END"
_nudge_values = ", ".join("(" + ", ".join("'" + v.replace("'", "''") + "'" for v in row) + ")" for row in NU.NUDGES)
_urgency_case = "CASE alert_level " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in NU.URGENCY.items()) + " ELSE 'TIP' END"

SEG_CTE = f""", seg0 AS (SELECT *, CAST(user_id % 4 AS INT) AS cluster FROM prof),
popf AS (SELECT {", ".join(f"avg(coalesce({c}, 0)) AS {c}__mean, CASE WHEN stddev_samp(coalesce({c}, 0)) <= 1e-12 THEN 1.0 ELSE stddev_samp(coalesce({c}, 0)) END AS {c}__std" for c in CF)} FROM seg0),
cprof AS (SELECT cluster, {", ".join(f"avg({c}) AS {c}" for c in CF)}, avg(risk_score) AS risk_score,
          count(*) AS user_count FROM seg0 GROUP BY cluster),
cz AS (SELECT cluster, {", ".join(c for c in CF)}, risk_score, user_count,
       {", ".join(f"({c} - {c}__mean) / {c}__std AS z_{c}" for c in CF)} FROM cprof, popf),
pers AS (SELECT cluster, coalesce({_persona_case}, 'Cluster ' || CAST(cluster AS VARCHAR)) AS persona FROM
         (SELECT cluster, {_argmax({c: f"z_{c}" for c in CF})} AS dom FROM cz)),
popu AS (SELECT {", ".join(f"avg({c}) AS {c}__mean, CASE WHEN stddev_samp({c}) <= 1e-12 THEN 1.0 ELSE stddev_samp({c}) END AS {c}__std" for c in CF)} FROM seg0),
seg AS (SELECT s.*, p.persona, {_argmax({c: f"(s.{c} - u.{c}__mean) / u.{c}__std" for c in CF})} AS dominant_signal
        FROM seg0 s LEFT JOIN pers p USING (cluster), popu u)
"""

_W = 'PARTITION BY user_id ORDER BY "timestamp", transaction_id'
NEXT_CTE = f""", nx0 AS (SELECT *, row_number() OVER ({_W}) AS rn FROM scored),
nxf AS (SELECT *,
  {", ".join(f"lag({c}, {k}) OVER ({_W}) AS lag{k}_{c}" for k in (1, 2, 3) for c in ("impulse_prob", "impulse_label", "spend_zscore"))},
  CAST((2 * sum(CAST(round(impulse_prob * 1000000) AS BIGINT)) OVER ({_W} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)
        + count(impulse_prob) OVER ({_W} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING))
       // (2 * nullif(count(impulse_prob) OVER ({_W} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 0)) AS BIGINT) / 1000000 AS roll5_impulse_prob_mean,
  max(impulse_prob) OVER ({_W} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS roll5_impulse_prob_max,
  avg(impulse_label) OVER ({_W} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS roll5_impulse_rate,
  coalesce((epoch_us("timestamp") - epoch_us(lag("timestamp", 1) OVER ({_W}))) / 3.6e9, 0.0) AS hours_since_last_txn,
  CAST(rn - 1 - coalesce(max(CASE WHEN coalesce(impulse_label, 0) <> 1 THEN rn END)
       OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INT) AS impulse_streak,
  lead(impulse_label, 1) OVER ({_W}) AS next_impulse
 FROM nx0),
nxd AS (SELECT f.* EXCLUDE (rn), g.risk_score, g.recency_weighted_prob, g.impulse_prob_std, g.cluster
        FROM nxf f LEFT JOIN seg g USING (user_id) WHERE f.next_impulse IS NOT NULL),
latest AS (SELECT user_id, impulse_prob AS next_impulse_prob FROM
  (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY "timestamp" DESC, transaction_id DESC) AS r FROM scored)
  WHERE r = 1),
atrisk AS (SELECT l.user_id, l.next_impulse_prob, g.risk_score, g.risk_tier, g.raw_impulse_rate, g.persona, g.cluster,
  CASE WHEN next_impulse_prob >= 0.75 THEN 'Immediate Alert' WHEN next_impulse_prob >= 0.55 THEN 'Warning'
       WHEN next_impulse_prob >= 0.35 THEN 'Watch' ELSE 'Safe' END AS alert_level
 FROM latest l LEFT JOIN seg g USING (user_id)),
nudge_lib(signal, nudge_title, nudge_message, nudge_tip, nudge_icon) AS (VALUES {_nudge_values}),
full0 AS (SELECT a.*, g.dominant_signal, g.potential_savings, g.late_night_rate, g.balance_stress_rate,
                 g.mean_spend_zscore, g.pred_impulse_rate FROM atrisk a LEFT JOIN seg g USING (user_id)),
nudged AS (SELECT f.*, n.nudge_title, n.nudge_message, n.nudge_tip, n.nudge_icon,
  CASE WHEN coalesce(potential_savings, 0) > 0 THEN 'Redirecting those impulse purchases could have saved about Rs.'
       || format('{{:,.0f}}', potential_savings) || ' this period.' ELSE '' END AS savings_line,
  {_urgency_case} AS urgency
 FROM full0 f LEFT JOIN nudge_lib n ON n.signal = CASE WHEN f.dominant_signal IN
   ({", ".join(f"'{r[0]}'" for r in NU.NUDGES)}) THEN f.dominant_signal ELSE 'pred_impulse_rate' END),
nudges AS (SELECT *, trim('[' || urgency || '] ' || nudge_title || chr(10) || nudge_message || chr(10) || savings_line
                          || chr(10) || 'What to do: ' || nudge_tip, ' ' || chr(10) || chr(9) || chr(13)) AS full_nudge FROM nudged)
"""


def nsql(select: str, doubles=()) -> str:
    body = select
    if doubles:
        body = "SELECT * REPLACE (" + ", ".join(f"round({c}, 6) AS {c}" for c in doubles) + f") FROM ({select}) q"
    return with_ctes("prof").rstrip("\n") + SEG_CTE.rstrip("\n") + NEXT_CTE + body


# ------------------------------------------------------------------------------------------ segmentation
@register("a17_population_stats", nsql(
    "SELECT " + ", ".join(f"{c}__mean, {c}__std" for c in CF) + " FROM popu",
    [f"{c}__{s}" for c in CF for s in ("mean", "std")]))
def a17(spark, sf):
    """Population mean and sample std (zero -> 1) of the ten user signals."""
    return S.population_stats(I.profile(spark, sf), CF)


_A10 = CF + ["risk_score"] + [f"z_{c}" for c in CF]


@register("a10_cluster_profile", nsql("SELECT * FROM cz", _A10))
def a10(spark, sf):
    """A10: cluster means, size and z-profile (cluster = user_id % 4 stand-in)."""
    p = I.profile(spark, sf).withColumn("cluster", (F.col("user_id") % 4).cast("int"))
    return SG.cluster_profile(p)


@register("p21_persona", nsql("SELECT user_id, cluster, persona FROM seg"))
def p21(spark, sf):
    """Persona from the dominant z signal of the user's cluster (broadcast per-cluster table)."""
    return I.segmented(spark, sf).select("user_id", "cluster", "persona")


@register("p22_dominant_signal", nsql("SELECT user_id, dominant_signal FROM seg"))
def p22(spark, sf):
    """Per-user argmax of |z| over ten signals, first column wins ties."""
    return I.segmented(spark, sf).select("user_id", "dominant_signal")


@register("j08_with_population", nsql(
    "SELECT s.user_id, (s.late_night_rate - u.late_night_rate__mean) / u.late_night_rate__std AS z_late_night_rate "
    "FROM seg0 s, popu u", ["z_late_night_rate"]))
def j08(spark, sf):
    """Every user x the one-row population statistics (broadcast)."""
    p = I.profile(spark, sf)
    pop = S.population_stats(p, ["late_night_rate"])
    return SG.with_population(p, pop).select(
        "user_id", ((F.col("late_night_rate") - F.col("late_night_rate__mean")) / F.col("late_night_rate__std"))
        .alias("z_late_night_rate"))


@register("a11_persona_summary", nsql(
    "SELECT cluster, persona, count(user_id) AS user_count, avg(risk_score) AS avg_risk_score, "
    "avg(raw_impulse_rate) AS avg_impulse_rate FROM seg GROUP BY cluster, persona",
    ["avg_risk_score", "avg_impulse_rate"]))
def a11(spark, sf):
    return SG.persona_summary(I.segmented(spark, sf))


@register("a23_cluster_summary", nsql(
    "SELECT cluster, count(*) AS user_count, min(persona) AS persona, avg(risk_score) AS avg_risk_score, "
    "avg(raw_impulse_rate) AS avg_impulse_rate FROM seg GROUP BY cluster", ["avg_risk_score", "avg_impulse_rate"]))
def a23(spark, sf):
    return SG.cluster_summary(I.segmented(spark, sf))


# ------------------------------------------------------------------------------------------ next transaction
_LAGS = [f"lag{k}_{c}" for k in (1, 2, 3) for c in ("impulse_prob", "impulse_label", "spend_zscore")]
_LAG_D = [c for c in _LAGS if "label" not in c]


@register("w06_lags", nsql(f"SELECT transaction_id, {', '.join(_LAGS)} FROM nxf", _LAG_D))
def w06(spark, sf):
    """Lags 1-3 of probability, label and z-score per user."""
    return I.next_features(spark, sf).select("transaction_id", *_LAGS)


@register("w07_next_label", nsql("SELECT transaction_id, next_impulse FROM nxf"))
def w07(spark, sf):
    return I.next_features(spark, sf).select("transaction_id", "next_impulse")


_R5 = ["roll5_impulse_prob_mean", "roll5_impulse_prob_max", "roll5_impulse_rate"]


@register("w08_rolling5", nsql(f"SELECT transaction_id, {', '.join(_R5)} FROM nxf", _R5))
def w08(spark, sf):
    return I.next_features(spark, sf).select("transaction_id", *_R5)


@register("w09_hours_since_last", nsql("SELECT transaction_id, hours_since_last_txn FROM nxf", ["hours_since_last_txn"]))
def w09(spark, sf):
    return I.next_features(spark, sf).select("transaction_id", "hours_since_last_txn")


@register("w10_streak", nsql("SELECT transaction_id, impulse_streak FROM nxf"))
def w10(spark, sf):
    """Consecutive impulses right before each transaction (gaps and islands, no per-row loop)."""
    return I.next_features(spark, sf).select("transaction_id", "impulse_streak")


_NXD = ["transaction_id", "user_id", "next_impulse"] + [c for c in NX.NEXT_FEATURES]
_NXD_D = ([c for c in _LAG_D if c in NX.NEXT_FEATURES] + _R5 + ["hours_since_last_txn", "spend_zscore", "spend_to_salary_ratio",
                                        "category_impulse_risk", "drawdown_ratio", "risk_score",
                                        "recency_weighted_prob", "impulse_prob_std", "user_impulse_rate"])


@register("m16_next_txn_dataset", nsql(f"SELECT {', '.join(_NXD)} FROM nxd", _NXD_D))
def m16(spark, sf):
    """M16 (+ J3, F2): sequence features, user columns, rows without a next transaction dropped."""
    return I.next_dataset(spark, sf).select(*_NXD)


@register("m13_time_split", nsql(
    "SELECT count(*) FILTER (WHERE epoch_us(\"timestamp\") <= q) AS train_rows, "
    "count(*) FILTER (WHERE epoch_us(\"timestamp\") > q) AS test_rows, "
    "avg(next_impulse) FILTER (WHERE epoch_us(\"timestamp\") <= q) AS train_rate, "
    "avg(next_impulse) FILTER (WHERE epoch_us(\"timestamp\") > q) AS test_rate "
    "FROM nxd, (SELECT quantile_cont(epoch_us(\"timestamp\"), 0.8) AS q FROM nxd)", ["train_rate", "test_rate"]))
def m13(spark, sf):
    """M13 + F3: split the next-transaction set at the exact 0.8 quantile of time."""
    ds = I.next_labelled(spark, sf).select("timestamp", "next_impulse")
    train, test, _ = NX.time_split(ds, 0.8)
    a = train.agg(F.count(F.lit(1)).alias("train_rows"), F.avg("next_impulse").alias("train_rate"))
    b = test.agg(F.count(F.lit(1)).alias("test_rows"), F.avg("next_impulse").alias("test_rate"))
    return a.crossJoin(b)


_FOLD_SQL = """SELECT transaction_id, CAST(CASE
   WHEN pos >= s4 THEN 4 WHEN pos >= s3 THEN 3 WHEN pos >= s2 THEN 2 WHEN pos >= s1 THEN 1 ELSE 0 END AS INT) AS fold
 FROM (SELECT transaction_id, next_impulse,
   row_number() OVER (PARTITION BY next_impulse ORDER BY user_id, "timestamp", transaction_id) - 1 AS pos,
   {starts} FROM nxd, (SELECT count(*) FILTER (WHERE next_impulse = 0) AS n0, count(*) AS n FROM nxd))"""


def _fold_starts():
    # start of fold f inside class c = number of positions p in the class's range with p % 5 < f
    out = []
    for f in range(1, 5):
        terms0 = " + ".join(f"(CASE WHEN {i} < n0 THEN (n0 - 1 - {i}) // 5 + 1 ELSE 0 END)" for i in range(f))
        terms1 = " + ".join(
            f"(CASE WHEN n0 + ((({i} - n0) % 5) + 5) % 5 < n THEN (n - 1 - (n0 + ((({i} - n0) % 5) + 5) % 5)) // 5 + 1 ELSE 0 END)"
            for i in range(f))
        out.append(f"CASE WHEN next_impulse = 0 THEN {terms0} ELSE {terms1} END AS s{f}")
    return ", ".join(out)


@register("m15_block_folds", nsql(_FOLD_SQL.format(starts=_fold_starts())))
def m15(spark, sf):
    """Unshuffled stratified 5-fold assignment without a global sort."""
    ds = I.Ctx(spark, sf).next_labelled.select("transaction_id", "user_id", "timestamp", "next_impulse")
    return NX.block_folds(ds).select("transaction_id", "fold")


@register("w13_latest_per_user", nsql(
    "SELECT user_id, transaction_id, \"timestamp\" FROM (SELECT *, row_number() OVER (PARTITION BY user_id "
    "ORDER BY \"timestamp\" DESC, transaction_id DESC) AS r FROM txn) WHERE r = 1"))
def w13(spark, sf):
    """Newest row per user in one aggregate (max_by on (time, id))."""
    return NX.latest_per_user(I.txn(spark, sf).select("user_id", "transaction_id", "timestamp"))


_AR = ["next_impulse_prob", "risk_score", "raw_impulse_rate"]


@register("m17_at_risk_users", nsql("SELECT * FROM atrisk", _AR))
def m17(spark, sf):
    """M17 (+ J4, P20): latest prediction per user, profile columns, alert level."""
    return I.at_risk(spark, sf)


@register("m17_at_risk_labelled", nsql(
    "SELECT l.user_id, l.next_impulse_prob, g.risk_score, g.risk_tier, g.raw_impulse_rate, g.persona, g.cluster, "
    "CASE WHEN next_impulse_prob >= 0.75 THEN 'Immediate Alert' WHEN next_impulse_prob >= 0.55 THEN 'Warning' "
    "WHEN next_impulse_prob >= 0.35 THEN 'Watch' ELSE 'Safe' END AS alert_level FROM "
    "(SELECT user_id, impulse_prob AS next_impulse_prob FROM (SELECT *, row_number() OVER (PARTITION BY user_id "
    "ORDER BY \"timestamp\" DESC, transaction_id DESC) AS r FROM nxf WHERE next_impulse IS NOT NULL) WHERE r = 1) l "
    "LEFT JOIN seg g USING (user_id)", _AR))
def m17b(spark, sf):
    """M17, reference parity: the latest row that has a target (the second-to-last transaction)."""
    return I.Ctx(spark, sf, shared=True).at_risk_for("labelled")


@register("p20_alert_level", nsql("SELECT user_id, next_impulse_prob, alert_level FROM atrisk", ["next_impulse_prob"]))
def p20(spark, sf):
    return I.at_risk(spark, sf).select("user_id", "next_impulse_prob", "alert_level")


@register("a12_alert_summary", nsql(
    "SELECT alert_level, count(*) AS user_count, (SELECT count(*) FILTER (WHERE alert_level <> 'Safe') FROM atrisk) "
    "AS notified_users, (SELECT count(*) FILTER (WHERE alert_level = 'Safe') FROM atrisk) AS safe_users, "
    "CASE alert_level WHEN 'Immediate Alert' THEN 0 WHEN 'Warning' THEN 1 WHEN 'Watch' THEN 2 WHEN 'Safe' THEN 3 "
    "ELSE 4 END AS alert_order FROM atrisk GROUP BY alert_level"))
def a12(spark, sf):
    return NU.alert_summary(I.at_risk(spark, sf))


@register("a13_tier_alert_matrix", nsql(
    "SELECT risk_tier, " + ", ".join(f"count(*) FILTER (WHERE alert_level = '{a}') AS \"{a}\"" for a in C.ALERT_ORDER)
    + ", CASE risk_tier WHEN 'Critical' THEN 0 WHEN 'High' THEN 1 WHEN 'Moderate' THEN 2 WHEN 'Low' THEN 3 ELSE 4 END"
      " AS tier_order FROM atrisk GROUP BY risk_tier"))
def a13(spark, sf):
    """Tier x alert cross-tab with fixed level columns, zeros filled."""
    return NU.tier_alert_matrix(I.at_risk(spark, sf))


# ------------------------------------------------------------------------------------------ nudges
@register("a14_potential_savings", nsql("SELECT user_id, potential_savings FROM agg", ["potential_savings"]))
def a14(spark, sf):
    """Spend on predicted-impulse transactions per user (the profile folds it into its own aggregate)."""
    return NU.potential_savings(I.scored(spark, sf))


@register("j05_attach_savings", nsql("SELECT user_id, risk_tier, potential_savings FROM seg", ["potential_savings"]))
def j05(spark, sf):
    c = I.Ctx(spark, sf, shared=True)
    return NU.attach_savings(c.segmented.select("user_id", "risk_tier"), NU.potential_savings(c.scored))


@register("a15_savings_by_tier", nsql(
    "SELECT risk_tier, avg(potential_savings) AS avg_potential_savings FROM seg GROUP BY risk_tier",
    ["avg_potential_savings"]))
def a15(spark, sf):
    return NU.savings_by_tier(I.segmented(spark, sf))


_J6 = ["next_impulse_prob", "potential_savings", "late_night_rate", "balance_stress_rate", "mean_spend_zscore",
       "pred_impulse_rate"]


@register("j06_attach_signals", nsql(
    "SELECT user_id, next_impulse_prob, alert_level, dominant_signal, potential_savings, late_night_rate, "
    "balance_stress_rate, mean_spend_zscore, pred_impulse_rate FROM full0", _J6))
def j06(spark, sf):
    c = I.Ctx(spark, sf, shared=True)
    d = NU.attach_signals(c.at_risk, c.segmented)
    return d.select("user_id", "next_impulse_prob", "alert_level", "dominant_signal", *_J6[1:])


_NUDGE_COLS = ["user_id", "alert_level", "dominant_signal", "nudge_title", "nudge_icon", "nudge_message", "nudge_tip",
               "savings_line", "urgency", "full_nudge"]


@register("p26_full_nudge", nsql(f"SELECT {', '.join(_NUDGE_COLS)} FROM nudges"))
def p26(spark, sf):
    """P23-P26 + J7: template by dominant signal, urgency, savings sentence and the trimmed message."""
    return I.nudged(spark, sf).select(*_NUDGE_COLS)


@register("p23_nudge_lookup", nsql("SELECT user_id, dominant_signal, nudge_title, nudge_icon FROM nudges"))
def p23(spark, sf):
    return I.nudged(spark, sf).select("user_id", "dominant_signal", "nudge_title", "nudge_icon")


@register("p24_urgency", nsql("SELECT user_id, alert_level, urgency FROM nudges"))
def p24(spark, sf):
    return I.nudged(spark, sf).select("user_id", "alert_level", "urgency")


@register("p25_savings_line", nsql("SELECT user_id, potential_savings, savings_line FROM nudges", ["potential_savings"]))
def p25(spark, sf):
    return I.nudged(spark, sf).select("user_id", "potential_savings", "savings_line")


@register("a16_nudge_distribution", nsql(
    "SELECT nudge_title AS nudge_type, count(*) AS user_count FROM nudges GROUP BY nudge_title"))
def a16(spark, sf):
    """Users per nudge type."""
    return NU.distribution(I.nudged(spark, sf), "nudge_title").withColumnRenamed("nudge_title", "nudge_type")


@register("a16_signal_distribution", nsql(
    "SELECT dominant_signal, count(*) AS user_count FROM seg GROUP BY dominant_signal"))
def a16b(spark, sf):
    """Users per dominant signal."""
    return NU.distribution(I.segmented(spark, sf), "dominant_signal")


@register("p28_relabel", nsql(
    "SELECT dominant_signal, list_aggr(list_transform(string_split(replace(dominant_signal, '_', ' '), ' '), "
    "lambda w: upper(w[1]) || lower(w[2:])), 'string_agg', ' ') AS signal_label, count(*) AS user_count "
    "FROM seg GROUP BY dominant_signal"))
def p28(spark, sf):
    """Display labels for signals."""
    d = NU.distribution(I.segmented(spark, sf), "dominant_signal")
    return d.select("dominant_signal", NU.relabel(F.col("dominant_signal")).alias("signal_label"), "user_count")


@register("o03_top_k", nsql(
    "SELECT user_id, next_impulse_prob, risk_tier, alert_level FROM atrisk "
    "ORDER BY next_impulse_prob DESC, user_id LIMIT 10", ["next_impulse_prob"]))
def o03(spark, sf):
    """O3: the ten users most likely to impulse next (the limit is the feature)."""
    return NU.top_k(I.at_risk(spark, sf), "next_impulse_prob", 10, tiebreak="user_id").select(
        "user_id", "next_impulse_prob", "risk_tier", "alert_level")


@register("p31_anonymise", nsql(
    "SELECT user_id, risk_score, 'User ' || CAST(row_number() OVER (ORDER BY risk_score DESC, user_id) AS VARCHAR) "
    "AS display_name FROM (SELECT * FROM seg ORDER BY risk_score DESC, user_id LIMIT 15)", ["risk_score"]))
def p31(spark, sf):
    """Anonymised ``User n`` labels for the top-15 users by risk score."""
    top = NU.top_k(I.segmented(spark, sf), "risk_score", 15, tiebreak="user_id").select("user_id", "risk_score")
    return NU.anonymise(top)


@register("o04_order_by_levels", nsql(
    "SELECT user_id, risk_tier, CASE risk_tier WHEN 'Critical' THEN 0 WHEN 'High' THEN 1 WHEN 'Moderate' THEN 2 "
    "WHEN 'Low' THEN 3 ELSE 4 END AS tier_order FROM seg"))
def o04(spark, sf):
    """Custom categorical order key (Critical -> Low)."""
    return I.segmented(spark, sf).select("user_id", "risk_tier",
                                         C.level_order(F.col("risk_tier"), C.TIER_ORDER).alias("tier_order"))


@register("s07_to_records", nsql(
    "SELECT CAST(to_json(struct_pack(user_id := user_id, risk_tier := risk_tier, alert_level := alert_level)) AS VARCHAR)"
    " AS record "
    "FROM atrisk"))
def s07(spark, sf):
    """JSON records built on the executors."""
    from ..sources.transactions import to_records
    return to_records(I.at_risk(spark, sf).select("user_id", "risk_tier", "alert_level"))


def _hist(select, bins):
    from .q_stats import hist_sql
    return hist_sql(select, bins, None, False, ("prof",), extra_cte=SEG_CTE.rstrip("\n") + NEXT_CTE)


@register("a18_next_prob_histogram", _hist("SELECT 0 AS g, next_impulse_prob AS x FROM atrisk", 40))
def a18c(spark, sf):
    """40-bin histogram of the next-impulse probability over the at-risk list."""
    from ..operators.stats import histogram
    return histogram(I.at_risk(spark, sf), "next_impulse_prob", 40).select("bin", "count", "bin_lo", "bin_hi")

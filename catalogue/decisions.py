"""Metrics, leaderboards, governance gates and drift."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch import config
from tidewatch.functions import verdict
from tidewatch.operators import drift, governance, metrics, sampling
from tidewatch.session import shared_dir
from tidewatch.sources import flows as sources
from tidewatch.sources import sinks

from . import fixtures as fx
from .fixtures import per_class_ctes, quoted, sql, summary_cte

QUERIES, SQL = {}, {}


def register(name, fn, oracle):
    QUERIES[name] = fn
    if oracle:
        SQL[name] = oracle


# one scored feed --------------------------------------------------------------------

_pairs_one = "pairs AS (SELECT truth, prediction, count(*) AS n FROM scored WHERE truth IS NOT NULL GROUP BY 1, 2)"
_RATES = ["precision", "recall", "f1", "fnr"]
_rate_sql = ", ".join(f"round({m}, 6) AS {m}" for m in _RATES)
_sum_sql = ", ".join(f"round({m}, 6) AS {m}" for m in metrics.SUMMARY)


def _one(spark, sf):
    return metrics.evaluate(fx.scored(spark, sf))


register(
    "confusion_matrix",
    lambda s, d: _one(s, d)["confusion"],
    sql(["scored", "classes"], """SELECT a.label_class AS truth, a.class_id AS truth_id, b.label_class AS prediction, b.class_id AS prediction_id, coalesce(p.n, 0) AS n
FROM classes a CROSS JOIN classes b LEFT JOIN pairs p ON p.truth = a.label_class AND p.prediction = b.label_class""", [_pairs_one]),
)
register(
    "confusion_pivot",
    lambda s, d: metrics.confusion_pivot(metrics.pair_counts(fx.scored(s, d))),
    sql(["scored", "classes"], "SELECT c.class_id AS truth_id, c.label_class AS truth, " + ", ".join(
        f"CAST(coalesce(sum(n) FILTER (prediction = {quoted(n)}), 0) AS BIGINT) AS \"{n}\"" for n in config.CLASSES)
        + " FROM classes c LEFT JOIN pairs p ON p.truth = c.label_class GROUP BY 1, 2", [_pairs_one]),
)
register(
    "per_class_metrics",
    lambda s, d: fx.rounded(_one(s, d)["per_class"], _RATES),
    sql(["scored", "classes"], f"SELECT class_id, label_class, support, {_rate_sql}, tp, fn, fp, tn, insufficient_test_support FROM pc", [_pairs_one, per_class_ctes("pairs", "")]),
)
register(
    "metric_summary",
    lambda s, d: fx.rounded(_one(s, d)["summary"], metrics.SUMMARY),
    sql(["scored", "classes"], f"SELECT test_samples, {_sum_sql} FROM sm", [_pairs_one, per_class_ctes("pairs", ""), summary_cte("")]),
)

# six models ---------------------------------------------------------------------------

_BY = ("model", "ord")
_pairs_many = "pairs AS (SELECT model, ord, truth, prediction, count(*) AS n FROM model_verdicts GROUP BY 1, 2, 3, 4)"
_many = [_pairs_many, per_class_ctes("pairs", "model, ord"), summary_cte("model, ord")]
_USE = ["model_verdicts", "classes"]


def _models(spark, sf):
    return metrics.evaluate(fx.model_verdicts(spark, sf), by=_BY)


register(
    "model_confusion",
    lambda s, d: _models(s, d)["confusion"].where("n > 0").select("model", "truth", "prediction", "n"),
    sql(_USE, "SELECT model, truth, prediction, n FROM pairs", [_pairs_many]),
)
register(
    "model_per_class",
    lambda s, d: fx.rounded(_models(s, d)["per_class"], _RATES),
    sql(_USE, f"SELECT model, ord, class_id, label_class, support, {_rate_sql}, tp, fn, fp, tn, insufficient_test_support FROM pc", _many),
)
register(
    "model_summaries",
    lambda s, d: fx.rounded(_models(s, d)["summary"], metrics.SUMMARY),
    sql(_USE, f"SELECT model, ord, test_samples, {_sum_sql} FROM sm", _many),
)
register(
    "metrics_flattened",
    lambda s, d: fx.rounded((lambda t: metrics.flatten_metrics(t["per_class"], t["summary"], _BY))(_models(s, d)), ["value"]),
    sql(_USE, " UNION ALL ".join(
        [f"SELECT model, ord, {quoted(m)} AS metric, round({m}, 6) AS value FROM sm" for m in metrics.SUMMARY]
        + [f"SELECT model, ord, concat('per_class.', label_class, '.{m}'), round(CAST({m} AS DOUBLE), 6) FROM pc WHERE support > 0" for m in [*_RATES, "support"]]), _many),
)


def metric_documents(spark, sf):
    t = _models(spark, sf)
    doc = metrics.metrics_document(t["per_class"], t["summary"], _BY)
    return doc.select("model", "ord", "test_samples", F.col("summary.macro_f1").alias("macro_f1"), F.col("per_class")["DoS"]["fnr"].alias("dos_fnr"), F.size("per_class").alias("classes"))


register("metric_documents", metric_documents, sql(_USE, "SELECT sm.model, sm.ord, test_samples, round(macro_f1, 6) AS macro_f1, round(fnr, 6) AS dos_fnr, 8 AS classes FROM sm JOIN pc ON pc.model = sm.model AND pc.label_class = 'DoS'", _many))
register(
    "leaderboard",
    lambda s, d: metrics.leaderboard(_models(s, d)["summary"]).select("model", "rank", F.round("macro_f1", 6).alias("macro_f1")),
    sql(_USE, "SELECT model, CAST(row_number() OVER (ORDER BY macro_f1 DESC, mean_attack_fnr, macro_attack_f1 DESC, ord) AS INTEGER) AS rank, round(macro_f1, 6) AS macro_f1 FROM sm", _many),
)
register(
    "metric_rankings",
    lambda s, d: metrics.metric_rankings(_models(s, d)["summary"].withColumn("latency", F.pmod(F.col("ord") * 5, F.lit(7))), "latency").drop("ord"),
    sql(_USE, """SELECT model, CAST(row_number() OVER (ORDER BY macro_f1 DESC, ord) AS INTEGER) AS by_macro_f1, CAST(row_number() OVER (ORDER BY mean_attack_fnr, ord) AS INTEGER) AS by_lowest_attack_fnr,
 CAST(row_number() OVER (ORDER BY macro_attack_f1 DESC, ord) AS INTEGER) AS by_macro_attack_f1, CAST(row_number() OVER (ORDER BY (ord * 5) % 7, ord) AS INTEGER) AS by_lowest_latency FROM sm""", _many),
)
register(
    "recommended_champion",
    lambda s, d: fx.rounded(metrics.recommend(_models(s, d)["summary"]), ["macro_f1"]),
    sql(_USE, "SELECT model AS provisional_champion, round(macro_f1, 6) AS macro_f1 FROM sm ORDER BY sm.macro_f1 DESC, mean_attack_fnr, macro_attack_f1 DESC LIMIT 1", _many),
)

# governance ---------------------------------------------------------------------------

_attack = "support > 0 AND label_class <> 'BENIGN'"
_gm = f"""gm AS (SELECT s.model, s.ord, s.accuracy, s.macro_f1, s.mean_attack_fnr, s.macro_attack_f1, w.worst_attack_class, w.worst_attack_fnr, b.breach_count, z.no_support
FROM sm s JOIN (SELECT model, label_class AS worst_attack_class, fnr AS worst_attack_fnr FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY fnr DESC, class_id) AS r FROM pc WHERE {_attack}) WHERE r = 1) w USING (model)
JOIN (SELECT model, count(*) FILTER ({_attack} AND fnr > 0.30) AS breach_count FROM pc GROUP BY 1) b USING (model)
JOIN (SELECT model, string_agg(label_class, ',' ORDER BY class_id) FILTER (support = 0) AS no_support FROM pc GROUP BY 1) z USING (model))"""


def _gates(spark, sf):
    t = _models(spark, sf)
    return governance.gate_metrics(t["per_class"], t["summary"], _BY)


register(
    "gate_metrics",
    lambda s, d: fx.rounded(_gates(s, d).select(
        "model", "ord", "accuracy", "macro_f1", "mean_attack_fnr", "macro_attack_f1", "worst_attack_class", "worst_attack_fnr",
        F.size("breaches").cast("long").alias("breach_count"), F.array_join("classes_without_test_support", ",").alias("no_support")),
        ["accuracy", "macro_f1", "mean_attack_fnr", "macro_attack_f1", "worst_attack_fnr"]),
    sql(_USE, "SELECT model, ord, round(accuracy, 6) AS accuracy, round(macro_f1, 6) AS macro_f1, round(mean_attack_fnr, 6) AS mean_attack_fnr, round(macro_attack_f1, 6) AS macro_attack_f1,"
        " worst_attack_class, round(worst_attack_fnr, 6) AS worst_attack_fnr, breach_count, coalesce(no_support, '') AS no_support FROM gm", [*_many, _gm]),
)
register(
    "gate_breaches",
    lambda s, d: fx.rounded(governance.breaches(_models(s, d)["per_class"], _BY), ["fnr"]),
    sql(_USE, f"SELECT model, ord, class_id, label_class, round(fnr, 6) AS fnr FROM pc WHERE {_attack} AND fnr > 0.30", _many),
)


def gate_decisions(spark, sf):
    """Each model against the one before it; the first has no incumbent."""
    rows = _gates(spark, sf)
    before = rows.select((F.col("ord") + 1).alias("ord"), F.col("model").alias("champion"))
    decided = governance.decide(governance.against(rows.join(F.broadcast(before), "ord", "left"), rows))
    passed = lambda i: F.coalesce(F.get("gates", F.lit(i))["passed"], F.lit(True))
    return decided.select(
        "model", "champion", "decision", "promoted", F.size("gates").alias("gate_count"),
        *[passed(i).alias(f"gate_{i + 1}") for i in range(4)], F.element_at("reasons", 1).alias("verdict_text"),
    )


register("gate_decisions", gate_decisions, sql(_USE, """SELECT model, champion, CASE WHEN ok THEN 'PROMOTED' ELSE 'REJECTED' END AS decision, ok AS promoted, gate_count, gate_1, gate_2, gate_3, gate_4,
 CASE WHEN ok THEN concat('All ', gate_count, ' governance gates passed.') ELSE concat('Rejected: ', CAST(NOT gate_1 AS INT) + CAST(NOT gate_2 AS INT) + CAST(NOT gate_3 AS INT) + CAST(NOT gate_4 AS INT), ' of ', gate_count, ' governance gates failed.') END AS verdict_text
FROM (SELECT *, gate_1 AND gate_2 AND gate_3 AND gate_4 AS ok FROM (SELECT a.model, b.model AS champion, CASE WHEN b.model IS NULL THEN 3 ELSE 4 END AS gate_count,
 a.mean_attack_fnr <= 0.10 AS gate_1, a.breach_count = 0 AS gate_2, coalesce(a.macro_f1 >= b.macro_f1 + 0.001, true) AS gate_3, coalesce(a.mean_attack_fnr <= b.mean_attack_fnr, true) AS gate_4
 FROM gm a LEFT JOIN gm b ON b.ord = a.ord - 1))""", [*_many, _gm]))

_replay = """replay AS (
 SELECT CAST(-1 AS BIGINT) AS ord, CAST(NULL AS VARCHAR) AS challenger, CAST(NULL AS VARCHAR) AS incumbent, CAST(NULL AS VARCHAR) AS champ, CAST(NULL AS DOUBLE) AS f1, CAST(NULL AS DOUBLE) AS fnr, false AS promoted
 UNION ALL
 SELECT g.ord, g.model, r.champ, CASE WHEN won THEN g.model ELSE r.champ END, CASE WHEN won THEN g.macro_f1 ELSE r.f1 END, CASE WHEN won THEN g.mean_attack_fnr ELSE r.fnr END, won
 FROM replay r JOIN gm g ON g.ord = r.ord + 1, LATERAL (SELECT g.mean_attack_fnr <= 0.10 AND g.breach_count = 0 AND (r.champ IS NULL OR (g.macro_f1 >= r.f1 + 0.001 AND g.mean_attack_fnr <= r.fnr)) AS won))"""
_log = [*_many, _gm, _replay]
register(
    "governance_replay",
    lambda s, d: governance.replay(_gates(s, d)),
    sql(_USE, "SELECT ord, challenger, incumbent AS champion, promoted FROM replay WHERE ord >= 0", _log),
)


def decision_log(spark, sf):
    """Replayed decisions, appended to a log on storage and read back."""
    rows = _gates(spark, sf)
    replayed = governance.replay(rows).withColumnRenamed("champion", "old")
    joined = rows.join(replayed.select("ord", F.col("old").alias("champion")), "ord")
    decided = governance.decide(governance.against(joined, rows))
    path = shared_dir(spark, "decisions")
    figures = F.struct("macro_f1", "mean_attack_fnr", "macro_attack_f1", "accuracy", "worst_attack_class", "worst_attack_fnr")
    record = decided.select(
        F.col("ord").alias("seq"), verdict.utc_now_iso().alias("timestamp"), F.col("model").alias("challenger"), "champion", "decision",
        "promoted", "gates", "reasons", "thresholds", figures.alias("challenger_metrics"))
    sinks.append_decision(record, path)
    return sources.read_decisions(spark, path)


register(
    "governance_log",
    lambda s, d: governance.incumbents(decision_log(s, d)).select("seq", "challenger", "champion", "promoted", "incumbent"),
    sql(_USE, "SELECT ord AS seq, challenger, incumbent AS champion, promoted, incumbent FROM replay WHERE ord >= 0", _log),
)
register(
    "governance_summary",
    lambda s, d: governance.history_summary(decision_log(s, d)).select("total_decisions", "promotions", "rejections", F.col("thresholds.max_mean_fnr").alias("max_mean_fnr"), "current_champion"),
    sql(_USE, """SELECT count(*) AS total_decisions, count(*) FILTER (promoted) AS promotions, count(*) FILTER (NOT promoted) AS rejections, CAST(0.1 AS DOUBLE) AS max_mean_fnr,
 arg_max(challenger, ord) FILTER (promoted) AS current_champion FROM replay WHERE ord >= 0""", _log),
)
register(
    "governance_current_champion",
    lambda s, d: governance.current_champion(decision_log(s, d)).select("seq", "challenger"),
    sql(_USE, "SELECT ord AS seq, challenger FROM replay WHERE promoted ORDER BY ord DESC LIMIT 1", _log),
)


def production_classes(spark, sf):
    champion = governance.current_champion(decision_log(spark, sf)).select(F.col("challenger").alias("model"))
    return fx.rounded(governance.production_report(_models(spark, sf)["per_class"], champion).select("model", "label_class", "support", "fnr", "recall", "f1", "status"), _RATES[1:])


register("governance_production_classes", production_classes, sql(_USE, """SELECT p.model, label_class, support, round(p.fnr, 6) AS fnr, round(recall, 6) AS recall, round(p.f1, 6) AS f1,
 CASE WHEN support = 0 THEN 'NO_TEST_SUPPORT' WHEN label_class = 'BENIGN' THEN 'OK' WHEN p.fnr <= 0.30 THEN 'OK' ELSE 'BREACH' END AS status
FROM pc p WHERE model = (SELECT challenger FROM replay WHERE promoted ORDER BY ord DESC LIMIT 1)""", _log))
register(
    "class_status_by_model",
    lambda s, d: governance.class_report(_models(s, d)["per_class"]).select("model", "label_class", "status"),
    sql(_USE, "SELECT model, label_class, CASE WHEN support = 0 THEN 'NO_TEST_SUPPORT' WHEN label_class = 'BENIGN' THEN 'OK' WHEN fnr <= 0.30 THEN 'OK' ELSE 'BREACH' END AS status FROM pc", _many),
)


def run_history(spark, sf):
    """Orders as runs: start, duration and text time, the first 200 by start."""
    runs = fx.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("run_id"), F.expr("o_orderkey * 1000 + 1700000000000").alias("start_ms"), F.expr("o_orderkey * 1000 + 1700000000000 + o_custkey").alias("end_ms"))
    return governance.run_history(runs).select(
        "run_id", verdict.millis_to_iso(F.col("start_ms")).alias("started_at"), verdict.duration_seconds(F.col("start_ms"), F.col("end_ms")).alias("duration_seconds"))


register("run_history", run_history, """SELECT o_orderkey AS run_id, strftime(make_timestamp((o_orderkey * 1000 + 1700000000000) * 1000), '%Y-%m-%dT%H:%M:%S.%gZ') AS started_at, o_custkey / CAST(1000 AS DOUBLE) AS duration_seconds
FROM orders ORDER BY o_orderkey LIMIT 200""")

# drift ----------------------------------------------------------------------------------

_F = fx.DRIFT_FEATURES
_long = lambda side: " UNION ALL ".join(f"SELECT {i} AS pos, {quoted(f)} AS feature, {f} AS value FROM {side}" for i, f in enumerate(_F))
_curve = [
    f"lr AS ({_long('reference')})", f"lc AS ({_long('current_side')})",
    "nr AS (SELECT pos, feature, count(*) AS n_ref, stddev_pop(value) AS spread FROM lr GROUP BY 1, 2)", "nc AS (SELECT feature, count(*) AS n_cur FROM lc GROUP BY 1)",
    "vals AS (SELECT feature, value, CAST(sum(a) AS BIGINT) AS n_ref, CAST(sum(b) AS BIGINT) AS n_cur FROM (SELECT feature, value, 1 AS a, 0 AS b FROM lr UNION ALL SELECT feature, value, 0, 1 FROM lc) GROUP BY 1, 2)",
    "curve AS (SELECT feature, value, n_ref, n_cur, CAST(sum(n_ref) OVER w AS BIGINT) AS cum_ref, CAST(sum(n_cur) OVER w AS BIGINT) AS cum_cur, lead(value) OVER (PARTITION BY feature ORDER BY value) AS next_value FROM vals WINDOW w AS (PARTITION BY feature ORDER BY value ROWS UNBOUNDED PRECEDING))",
    "dist AS (SELECT r.pos, feature, r.n_ref, c.n_cur, r.spread, max(abs(CAST(cum_ref AS DOUBLE) / r.n_ref - CAST(cum_cur AS DOUBLE) / c.n_cur)) AS statistic,"
    " coalesce(sum(abs(CAST(cum_ref AS DOUBLE) / r.n_ref - CAST(cum_cur AS DOUBLE) / c.n_cur) * (next_value - value)), 0.0) AS raw_distance FROM curve v JOIN nr r USING (feature) JOIN nc c USING (feature) GROUP BY 1, 2, 3, 4, 5)",
    "res AS (SELECT pos, feature, n_ref, n_cur, raw_distance, CASE WHEN spread > 0 THEN raw_distance / spread WHEN raw_distance = 0 THEN 0.0 ELSE CAST('Infinity' AS DOUBLE) END AS score FROM dist)",
]
_SIDES = ["reference", "current_side"]


def _detected(spark, sf, **kw):
    return drift.detect_drift(*fx.drift_sides(spark, sf), **kw)


register(
    "drift_ecdf",
    lambda s, d: drift.two_sample_ecdf(*fx.drift_sides(s, d), _F),
    sql(_SIDES, "SELECT r.pos, v.value, v.n_ref, v.n_cur, v.cum_ref, v.cum_cur, v.next_value FROM curve v JOIN nr r USING (feature)", _curve),
)
register(
    "drift_distances",
    lambda s, d: fx.rounded(drift.feature_distances(*fx.drift_sides(s, d), _F), ["spread", "statistic", "raw_distance"], 5),
    sql(_SIDES, "SELECT pos, feature, n_ref, n_cur, round(spread, 5) AS spread, round(statistic, 5) AS statistic, round(raw_distance, 5) AS raw_distance FROM dist", _curve),
)
register(
    "drift_features",
    lambda s, d: fx.rounded(_detected(s, d)["per_feature"].select("pos", "feature", "test", "score", "threshold", "drifted"), ["score"]),
    sql(_SIDES, "SELECT pos, feature, CASE WHEN least(n_ref, n_cur) < 2 THEN 'none' WHEN least(n_ref, n_cur) <= 1000 THEN 'ks' ELSE 'wasserstein' END AS test, round(score, 6) AS score, CAST(0.1 AS DOUBLE) AS threshold, score > 0.1 AS drifted FROM res", _curve),
)
register(
    "drift_verdict",
    lambda s, d: fx.rounded(_detected(s, d)["verdict"], ["drift_share"]),
    sql(_SIDES, "SELECT count(*) AS n_features, count(*) FILTER (score > 0.1) AS n_drifted_features, round(avg(CAST(score > 0.1 AS INT)), 6) AS drift_share, avg(CAST(score > 0.1 AS INT)) > 0.2 AS drift_detected FROM res", _curve),
)
register(
    "drift_top",
    lambda s, d: fx.rounded(_detected(s, d)["top"].select("feature", "test", "score", "threshold"), ["score"]),
    sql(_SIDES, "SELECT feature, 'wasserstein' AS test, round(score, 6) AS score, CAST(0.1 AS DOUBLE) AS threshold FROM res WHERE score > 0.1 ORDER BY score DESC, pos LIMIT 15", _curve),
)
register(
    "drift_ks_forced",
    lambda s, d: fx.rounded(_detected(s, d, stattest="ks")["per_feature"].select("pos", "feature", "test", "statistic", "n_ref", "n_cur"), ["statistic"]),
    sql(_SIDES, "SELECT pos, feature, 'ks' AS test, round(statistic, 6) AS statistic, n_ref, n_cur FROM dist", _curve),
)
# p-values of samples above 1,000 rows by the limiting law, which SQL can state; smaller ones are left to tests
_P = """CASE WHEN statistic >= 1 THEN 0e0 WHEN statistic <= 0 THEN 1e0 WHEN z * statistic * statistic > 18 THEN least(1e0, 2 * exp(-2 * z * statistic * statistic))
 ELSE least(1e0, greatest(0e0, 2 * list_sum([CASE WHEN k % 2 = 1 THEN 1e0 ELSE -1e0 END * exp(-2e0 * k * k * x * x) FOR k IN range(1, 101)]))) END"""
_P_FROM = "FROM (SELECT *, s + 1 / (6 * sqrt(z)) + (s - 1) / (4 * z) AS x FROM (SELECT *, sqrt(z) * statistic AS s FROM (SELECT *, round(CAST(n_ref AS DOUBLE) * n_cur / (n_ref + n_cur)) AS z FROM dist)))"
register("drift_ks_pvalues", lambda s, d: fx.rounded(_detected(s, d, stattest="ks", exact_limit=1000, series_from=1000)["per_feature"].select("feature", "score", "drifted"), ["score"]),
         sql(_SIDES, f"SELECT feature, round({_P}, 6) AS score, {_P} < 0.05 AS drifted {_P_FROM}", _curve))


def kept_reference(spark, sf):
    """Drift against a histogram of the reference that was written and read back, with the features in another order."""
    reference, current = fx.drift_sides(spark, sf)
    path = shared_dir(spark, "kept")
    drift.value_histogram(reference, _F[::-1]).write(path)
    return fx.rounded(drift.feature_distances(drift.ValueHistogram.read(spark, path), current, _F), ["spread", "statistic", "raw_distance"], 5)


register("drift_kept_reference", kept_reference,
         sql(_SIDES, "SELECT pos, feature, n_ref, n_cur, round(spread, 5) AS spread, round(statistic, 5) AS statistic, round(raw_distance, 5) AS raw_distance FROM dist", _curve))


def reference_snapshot(spark, sf):
    """Sampled snapshot with metadata, written and read back."""
    path = shared_dir(spark, "reference")
    snapshot = sampling.reference_sample(fx.labelled(spark, sf), 3000, "label_class", ["event_id"], strata=len(config.CLASSES)).select("value", "user_id", "label_class")
    sinks.write_snapshot(snapshot, path, ["value", "user_id"])
    meta = drift.reference_metadata(sources.read_snapshot(spark, path), ["value", "user_id"])
    return meta.select("reference_rows", "feature_count", F.explode("class_distribution").alias("label_class", "rows"))


register("drift_reference_metadata", reference_snapshot, sql(["labelled"], "SELECT CAST(sum(q) OVER () AS BIGINT) AS reference_rows, CAST(2 AS BIGINT) AS feature_count, label_class, q AS rows FROM quota", [
    "sizes AS (SELECT label_class, count(*) AS n FROM labelled GROUP BY 1), total AS (SELECT sum(n) AS t FROM sizes)",
    "quota AS (SELECT label_class, CASE WHEN t <= 3000 THEN n ELSE greatest(1, least(n, CAST(round_even(n * (3000.0 / t), 0) AS BIGINT))) END AS q FROM sizes, total)"]))

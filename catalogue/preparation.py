"""Fills, correlation, scalers, export preparation and exact sampling."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from tidewatch import config
from tidewatch.functions import names
from tidewatch.operators import preparing, quality, sampling, scaling
from tidewatch.plans.preparation import FlowPreparer, prepare_training_tables, split_counts
from tidewatch.session import shared_dir

from . import fixtures as fx
from .fixtures import finite_sql, ident, quoted, sql

QUERIES, SQL = {}, {}


def register(name, fn, oracle):
    QUERIES[name] = fn
    if oracle:
        SQL[name] = oracle


def _table(spark, values: dict[str, float], column: str):
    return spark.createDataFrame([(k, v) for k, v in values.items()], f"feature string, {column} double")


def _per_feature(expr: str, cols: list[str] | None = None) -> str:
    return " UNION ALL ".join(
        f"SELECT {quoted(n)} AS feature, {expr.format(x=finite_sql(ident(n)))} FROM features" for n in (cols or fx.NAMES)
    )


# fitted parameters ----------------------------------------------------------------

for _kind, _expr in {"median": "round(quantile_cont({x}, 0.5), 6)", "mean": "round(avg({x}), 4)", "zero": "min(CAST(0 AS DOUBLE))"}.items():
    register(
        f"fill_{_kind}",
        lambda s, d, k=_kind: fx.rounded(_table(s, scaling.fit_fills(fx.features(s, d), fx.NAMES, k), "fill"), ["fill"], 4 if k == "mean" else 6),
        sql(["features"], _per_feature(_expr + " AS fill")),
    )

# Sketch brackets and candidate counting, whatever the table size.
register(
    "fill_median_narrowed",
    lambda s, d: fx.rounded(_table(s, scaling.fit_fills(fx.features(s, d), fx.NAMES, "median", sketch=50), "fill"), ["fill"]),
    sql(["features"], _per_feature("round(quantile_cont({x}, 0.5), 6) AS fill")),
)


def _long_cells(df, cols):
    return df.select(*fx.KEY, F.inline(F.array(*[F.struct(F.lit(n).alias("feature"), names.c(n).alias("value")) for n in cols])))


def filled_rows(spark, sf):
    rows = fx.features(spark, sf, key=True)
    fills = scaling.fit_fills(rows, fx.LIVE, "median")
    out = scaling.apply_fills(rows, fills)
    return out.select(*fx.KEY, *[F.round(names.c(n), 6).alias(names.canonical_key(n)) for n in fx.LIVE])


_fill_cte = "p AS (SELECT " + ", ".join(f"quantile_cont({finite_sql(ident(n))}, 0.5) AS {ident(n)}" for n in fx.LIVE) + " FROM features)"
_filled = {n: f"coalesce({finite_sql('f.' + ident(n))}, p.{ident(n)})" for n in fx.LIVE}
register("fill_applied", filled_rows, sql(["features"], f"SELECT {', '.join(fx.KEY)}, " + ", ".join(
    f"round({_filled[n]}, 6) AS {names.canonical_key(n)}" for n in fx.LIVE) + " FROM features f, p", [_fill_cte]))


def fill_report(spark, sf):
    rows = fx.features(spark, sf)
    return fx.rounded(scaling.fill_report(rows, scaling.fit_fills(rows, fx.NAMES, "median")).drop("pos"), ["fill_value"])


register("fill_report", fill_report, sql(["features"], f"SELECT * FROM ({_per_feature('CAST(count(*) - count({x}) AS BIGINT) AS n_filled, round(quantile_cont({x}, 0.5), 6) AS fill_value')}) WHERE n_filled > 0"))

_pairs = [(i, j) for i in range(len(fx.LIVE)) for j in range(i + 1, len(fx.LIVE))]
register(
    "correlation_pairs",
    lambda s, d: fx.rounded(scaling.correlation_pairs(fx.features(s, d), fx.NAMES), ["r"]),
    sql(["features"], " UNION ALL ".join(
        f"SELECT {i} AS i, {j} AS j, {quoted(fx.NAMES[i])} AS \"left\", {quoted(fx.NAMES[j])} AS \"right\", "
        + ("round(corr({a}, {b}), 6)".format(a=finite_sql(ident(fx.NAMES[i])), b=finite_sql(ident(fx.NAMES[j]))) if "Zero" not in (fx.NAMES[i], fx.NAMES[j]) else "max(CAST(NULL AS DOUBLE))")
        + " AS r FROM features" for i in range(len(fx.NAMES)) for j in range(i + 1, len(fx.NAMES)))),
)


def correlated(spark, sf):
    rows = fx.features(spark, sf)
    filled = scaling.apply_fills(rows, scaling.fit_fills(rows, fx.NAMES, "median"))
    return spark.createDataFrame([(n,) for n in scaling.correlated_columns(filled, fx.NAMES)], "feature string")


register("correlation_dropped", correlated, sql(["features"], "SELECT DISTINCT feature FROM (" + " UNION ALL ".join(
    f"SELECT {quoted(fx.LIVE[j])} AS feature, corr({_filled[fx.LIVE[i]]}, {_filled[fx.LIVE[j]]}) AS r FROM features f, p" for i, j in _pairs)
    + ") WHERE abs(r) > 0.95 AND NOT isnan(r)", [_fill_cte]))


def _scaler(kind, digits=6):
    def run(spark, sf):
        center, scale = scaling.fit_scaler(fx.features(spark, sf), fx.NAMES, kind)
        rows = [(n, center[n], scale[n]) for n in fx.NAMES]
        return fx.rounded(spark.createDataFrame(rows, "feature string, center double, scale double"), ["center", "scale"], digits)

    return run


_one = "CASE WHEN {e} = 0 THEN 1.0 ELSE round({e}, 6) END AS scale"
register("scaler_robust", _scaler("robust"), sql(["features"], _per_feature("round(quantile_cont({x}, 0.5), 6) AS center, " + _one.replace("{e}", "(quantile_cont({x}, 0.75) - quantile_cont({x}, 0.25))"))))
register("scaler_standard", _scaler("standard", 4), sql(["features"], _per_feature("round(avg({x}), 4) AS center, " + _one.replace("{e}", "stddev_pop({x})").replace("6)", "4)"))))
register("scaler_minmax", _scaler("minmax"), sql(["features"], _per_feature("round(min({x}), 6) AS center, " + _one.replace("{e}", "(max({x}) - min({x}))"))))

_robust_cte = "p AS (SELECT " + ", ".join(
    f"quantile_cont({finite_sql(ident(n))}, 0.5) AS m{i}, quantile_cont({finite_sql(ident(n))}, 0.75) - quantile_cont({finite_sql(ident(n))}, 0.25) AS s{i}" for i, n in enumerate(fx.LIVE)) + " FROM features)"


def _robust(df):
    fills = scaling.fit_fills(df, fx.LIVE, "median")
    center, scale = scaling.fit_scaler(df, fx.LIVE, "robust")
    return scaling.Parameters(fx.LIVE, fills, center, scale)


_scaled_sql = [f"round((coalesce({finite_sql('f.' + ident(n))}, p.m{i}) - p.m{i}) / CASE WHEN p.s{i} = 0 THEN 1.0 ELSE p.s{i} END, 6)" for i, n in enumerate(fx.LIVE)]


def scaled_rows(spark, sf):
    rows = fx.features(spark, sf, key=True)
    params = _robust(rows)
    out = scaling.apply_scaler(scaling.apply_fills(rows, params.fill), params)
    return out.select(*fx.KEY, *[F.round(names.c(n), 6).alias(names.canonical_key(n)) for n in fx.LIVE])


register("scaled_rows", scaled_rows, sql(["features"], f"SELECT {', '.join(fx.KEY)}, " + ", ".join(
    f"{e} AS {names.canonical_key(n)}" for e, n in zip(_scaled_sql, fx.LIVE)) + " FROM features f, p", [_robust_cte]))


def scaled_long(spark, sf):
    rows = fx.features(spark, sf, key=True)
    picked = ["Flow Bytes/s", "Idle.Mean"]
    params = _robust(rows).slice(picked)
    return scaling.apply_long(_long_cells(rows, picked), params.to_df(spark)).select(*fx.KEY, "feature", F.round("scaled", 6).alias("scaled"))


register("scaled_long", scaled_long, sql(["features"], " UNION ALL ".join(
    f"SELECT {', '.join(fx.KEY)}, {quoted(fx.LIVE[i])} AS feature, {_scaled_sql[i]} AS scaled FROM features f, p" for i in (1, 2)), [_robust_cte]))

# exports ---------------------------------------------------------------------------

_TEXT = "CASE WHEN event_id % 11 = 0 THEN 'n/a' WHEN event_id % 13 = 1 THEN NULL WHEN event_id % 17 = 2 THEN 'inf' WHEN event_id % 19 = 3 THEN '1d' ELSE concat(' ', CAST(event_id % 1000 AS VARCHAR(9)), '.5 ') END"
_PARAMS = scaling.Parameters(
    ["Flow Duration", "Total Packets", "Idle Mean", "Packet Length Min", "Active Max"],
    {"Flow Duration": 50.0, "Total Packets": 7.0, "Idle Mean": 1.0, "Packet Length Min": 64.0, "Active Max": 2.5},
    {"Flow Duration": 40.0, "Total Packets": 5.0, "Idle Mean": 1.0, "Packet Length Min": 60.0, "Active Max": 2.0},
    {"Flow Duration": 8.0, "Total Packets": 2.0, "Idle Mean": 0.0, "Packet Length Min": 4.0, "Active Max": 0.5},
)


def _export(spark, sf):
    """Odd headers, text numbers, an alias, a repeated column and an absent one."""
    rows = fx.table(spark, sf, "events").selectExpr(
        "event_id", "value AS `flow_duration`", f"{_TEXT} AS `TOTAL-PACKETS`", "event_id % 3 AS ` Idle.Mean `",
        "value * 2 AS `Min Packet Length`", "value * 3 AS `packet length min`", "event_type AS Label")
    return names.normalize_columns(rows, _PARAMS.features)


_number_sql = f"CASE WHEN regexp_full_match(trim({{t}}), '[0-9]+\\.?[0-9]*') THEN CAST(trim({{t}}) AS DOUBLE) END"


def prepared_export(spark, sf):
    out = preparing.prepare(_export(spark, sf), _PARAMS, normalized=True, allow_missing=True, keep=["event_id"])
    return out.select("event_id", F.col("n_filled"), *[F.round(names.c(n), 6).alias(names.canonical_key(n)) for n in _PARAMS.features])


register("export_prepared", prepared_export, f"""
SELECT event_id, CASE WHEN n IS NULL THEN 1 ELSE 0 END AS n_filled, round((value - 40.0) / 8.0, 6) AS flowduration,
 round((coalesce(n, 7.0) - 5.0) / 2.0, 6) AS totalpackets, round(CAST(event_id % 3 AS DOUBLE) - 1.0, 6) AS idlemean,
 round((value * 2 - 60.0) / 4.0, 6) AS packetlengthmin, round((2.5 - 2.0) / 0.5, 6) AS activemax
FROM (SELECT event_id, value, {_number_sql.format(t='t')} AS n FROM (SELECT event_id, value, {_TEXT} AS t FROM events))""")
register(
    "export_display_values",
    lambda s, d: preparing.display_values(_export(s, d), _PARAMS, ["event_id"]).select(
        "event_id", names.c("Flow Duration").alias("duration"), names.c("Total Packets").alias("packets"), names.c("Active Max").alias("active")),
    f"""SELECT event_id, value AS duration, CASE WHEN trim(t) = 'inf' THEN CAST('Infinity' AS DOUBLE) ELSE coalesce(n, 7.0) END AS packets, CAST(2.5 AS DOUBLE) AS active
FROM (SELECT event_id, value, t, {_number_sql.format(t='t')} AS n FROM (SELECT event_id, value, {_TEXT} AS t FROM events))""",
)
register(
    "export_filled_total",
    lambda s, d: preparing.prepare(_export(s, d), _PARAMS, normalized=True, allow_missing=True).agg(F.sum("n_filled").alias("n_filled_cells")),
    f"SELECT count(*) FILTER (n IS NULL) AS n_filled_cells FROM (SELECT {_number_sql.format(t='t')} AS n FROM (SELECT {_TEXT} AS t FROM events))",
)
register(
    "export_rows_rejected",
    lambda s, d: preparing.split_valid(fx.features(s, d, key=True), fx.LIVE).select(
        *fx.KEY, "accepted", F.array_join("rejected_features", ";").alias("rejected")),
    sql(["features"], f"SELECT {', '.join(fx.KEY)}, " + " AND ".join(f"({finite_sql(ident(n))}) IS NOT NULL" for n in fx.LIVE) + " AS accepted, concat_ws(';', "
        + ", ".join(f"CASE WHEN ({finite_sql(ident(n))}) IS NULL THEN {quoted(n)} END" for n in fx.LIVE) + ") AS rejected FROM features"),
)
register(
    "export_context",
    lambda s, d: preparing.with_context(fx.table(s, d, "events").select("event_id", F.col("user_id").alias("dst_port"))),
    "SELECT event_id, user_id AS dst_port, '10.0.0.0' AS src_ip, '10.0.0.1' AS dst_ip, 'TCP' AS protocol_name FROM events",
)
register(
    "sample_weights",
    lambda s, d: fx.rounded(scaling.with_sample_weight(fx.labelled(s, d), "label_class", len(config.CLASSES)).select("event_id", "label_class", "weight"), ["weight"]),
    sql(["labelled"], """SELECT l.event_id, l.label_class, round(t.n / (t.k * c.n), 6) AS weight FROM labelled l
JOIN (SELECT label_class, count(*) AS n FROM labelled GROUP BY 1) c USING (label_class),
(SELECT CAST(count(*) AS DOUBLE) AS n, count(DISTINCT label_class) AS k FROM labelled) t"""),
)
register(
    "class_weights",
    lambda s, d: fx.rounded(scaling.class_weights(fx.labelled(s, d), "label_class"), ["weight"]),
    sql(["labelled"], """SELECT c.label_class, c.n AS rows, round(t.n / (t.k * c.n), 6) AS weight FROM
(SELECT label_class, count(*) AS n FROM labelled GROUP BY 1) c, (SELECT CAST(count(*) AS DOUBLE) AS n, count(DISTINCT label_class) AS k FROM labelled) t"""),
)

# sampling ---------------------------------------------------------------------------

_N = len(config.CLASSES)
_TOKEN = "md5(concat('42:', CAST(event_id AS VARCHAR)))"
_ranked = f"ranked AS (SELECT event_id, label_class, row_number() OVER (PARTITION BY label_class ORDER BY {_TOKEN}, event_id) AS rn FROM labelled)"
_sizes = "sizes AS (SELECT label_class, count(*) AS n FROM labelled GROUP BY 1), total AS (SELECT sum(n) AS t FROM sizes)"
_pick = "SELECT r.event_id, r.label_class FROM ranked r JOIN quota q USING (label_class) WHERE r.rn <= q.quota"
_ids = lambda df: df.select("event_id", "label_class")

register(
    "sample_stratified",
    lambda s, d: _ids(sampling.stratified_sample(fx.labelled(s, d), 2500, "label_class", ["event_id"], strata=_N)),
    sql(["labelled"], _pick, [_ranked, _sizes, "quota AS (SELECT label_class, least(n, greatest(1, CAST(floor(n * (2500.0 / t)) AS BIGINT))) AS quota FROM sizes, total)"]),
)
register(
    "sample_reference",
    lambda s, d: _ids(sampling.reference_sample(fx.labelled(s, d), 3000, "label_class", ["event_id"], strata=_N)),
    sql(["labelled"], _pick, [_ranked, _sizes, "quota AS (SELECT label_class, CASE WHEN t <= 3000 THEN n ELSE greatest(1, least(n, CAST(round_even(n * (3000.0 / t), 0) AS BIGINT))) END AS quota FROM sizes, total)"]),
)
register(
    "sample_uniform",
    lambda s, d: _ids(sampling.uniform_sample(fx.labelled(s, d), 1000, ["event_id"])),
    sql(["labelled"], f"SELECT event_id, label_class FROM labelled ORDER BY {_TOKEN}, event_id LIMIT 1000"),
)
register(
    "sample_half_attacks",
    lambda s, d: _ids(sampling.mixed_sample(fx.labelled(s, d), 4000, 0.5, "label_class", ["event_id"])),
    sql(["labelled"], """SELECT event_id, label_class FROM (SELECT *, row_number() OVER (PARTITION BY attack ORDER BY token, event_id) AS rn FROM r) r, a
WHERE rn <= CASE WHEN attack THEN a.n ELSE least(4000 - a.n, a.b) END""", [
        f"r AS (SELECT event_id, label_class, label_class <> 'BENIGN' AS attack, {_TOKEN} AS token FROM labelled)",
        "a AS (SELECT least(2000, count(*) FILTER (attack)) AS n, count(*) FILTER (NOT attack) AS b FROM r)"]),
)
_mix = ", ".join(f"({quoted(k)}, CAST({w} AS DOUBLE))" for k, w in config.ATTACK_MIX.items())
register(
    "sample_class_mix",
    lambda s, d: _ids(sampling.class_mix_sample(fx.labelled(s, d), 3000, 0.4, "label_class", ["event_id"], strata=_N)),
    sql(["labelled"], _pick, [
        _ranked, _sizes, f"mix(label_class, w) AS (VALUES {_mix})",
        "want AS (SELECT label_class, least(CAST(round_even(1200 * w / (sum(w) OVER ()), 0) AS BIGINT), n) AS quota FROM mix JOIN sizes USING (label_class))",
        "quota AS (SELECT * FROM want UNION ALL SELECT 'BENIGN', least(3000 - (SELECT sum(quota) FROM want), n) FROM sizes WHERE label_class = 'BENIGN')"]),
)
register(
    "sample_split",
    lambda s, d: sampling.train_test_split(fx.labelled(s, d), "label_class", ["event_id"], strata=_N).select("event_id", "label_class", "split"),
    sql(["labelled"], "SELECT r.event_id, r.label_class, CASE WHEN rn <= quota THEN 'train' ELSE 'test' END AS split FROM ranked r JOIN quota USING (label_class)", [
        _ranked, _sizes,
        "part AS (SELECT label_class, n, CASE WHEN n >= 2 THEN n ELSE 0 END AS m FROM sizes)",
        "goal AS (SELECT CAST(sum(m) AS BIGINT) AS t, CAST(sum(m) AS BIGINT) - CAST(ceil(CAST(0.2 AS DOUBLE) * sum(m)) AS BIGINT) AS train FROM part)",
        "share AS (SELECT label_class, n, CAST(m * train AS DOUBLE) / t AS exact, train FROM part, goal)",
        "lr AS (SELECT *, floor(exact) AS fl, row_number() OVER (ORDER BY exact - floor(exact) DESC, label_class) AS rk, train - sum(floor(exact)) OVER () AS extra FROM share)",
        "quota AS (SELECT label_class, CASE WHEN n < 2 THEN n ELSE fl + CASE WHEN rk <= extra THEN 1 ELSE 0 END END AS quota FROM lr)"]),
)
register(
    "sample_shuffled",
    lambda s, d: sampling.seeded_shuffle(fx.table(s, d, "events").select("event_id"), ["event_id"]).select("event_id", sampling.sample_token(["event_id"]).alias("token")),
    f"SELECT event_id, {_TOKEN} AS token FROM events",
)

# whole preparation --------------------------------------------------------------------

def prepared_counts(spark, sf):
    ready, _ = prepare_training_tables(_training(spark, sf), ["event_id"])
    return split_counts(ready)


def _training(spark, sf):
    rows = fx.labelled(spark, sf)
    return rows.select(
        "event_id", "label_class",
        F.when(F.col("event_id") % 31 == 0, None).otherwise(F.col("value")).alias("Flow Bytes/s"),
        (F.col("value") * 2 + 1).alias("Charge"), (F.col("event_id") % 17).cast("double").alias("Idle.Mean"),
        F.col("user_id").cast("double").alias("Subflow Fwd"), (F.col("value") + F.col("class_id") * 40).alias("Active Std"),
    )


register("prepared_split_counts", prepared_counts, sql(["labelled"], "SELECT split, label_class, count(*) AS rows FROM (" + SQL["sample_split"][SQL["sample_split"].index("SELECT r.event_id"):] + ") GROUP BY 1, 2", [
    SQL["sample_split"][SQL["sample_split"].index("ranked AS"):SQL["sample_split"].index(" SELECT r.event_id")]]))


def no_leak(spark, sf):
    """Fitted on the training half only; the SQL repeats fill and scale from there."""
    rows = fx.features(spark, sf, key=True).withColumn("split", F.when(F.col("l_orderkey") % 5 == 0, "test").otherwise("train"))
    model = FlowPreparer(fx.LIVE, correlation=0.95).fit(rows.where("split = 'train'"))
    out = model.transform(rows)
    return out.select(*fx.KEY, "split", *[F.round(names.c(n), 5).alias(names.canonical_key(n)) for n in model.features])


_train_filled = {n: f"coalesce({finite_sql('f.' + ident(n))}, p.{ident(n)})" for n in fx.LIVE}
register("prepared_without_leak", no_leak, sql(["features"], f"SELECT {', '.join('f.' + k for k in fx.KEY)}, CASE WHEN l_orderkey % 5 = 0 THEN 'test' ELSE 'train' END AS split, " + ", ".join(
    f"round(({_train_filled[n]} - q.m{i}) / CASE WHEN q.s{i} = 0 THEN 1.0 ELSE q.s{i} END, 5) AS {names.canonical_key(n)}" for i, n in enumerate(fx.LIVE[:4])) + " FROM features f, p, q", [
    "p AS (SELECT " + ", ".join(f"quantile_cont({finite_sql(ident(n))}, 0.5) AS {ident(n)}" for n in fx.LIVE) + " FROM features WHERE l_orderkey % 5 <> 0)",
    "q AS (SELECT " + ", ".join(f"quantile_cont({_train_filled[n]}, 0.5) AS m{i}, quantile_cont({_train_filled[n]}, 0.75) - quantile_cont({_train_filled[n]}, 0.25) AS s{i}" for i, n in enumerate(fx.LIVE[:4]))
    + " FROM features f, p WHERE l_orderkey % 5 <> 0)"]))


def reloaded(spark, sf):
    """The same from a pipeline that was saved and loaded in a session of its own."""
    rows = fx.features(spark, sf, key=True).withColumn("split", F.when(F.col("l_orderkey") % 5 == 0, "test").otherwise("train"))
    path = shared_dir(spark, "preparer")
    Pipeline(stages=[FlowPreparer(fx.LIVE, correlation=0.95)]).fit(rows.where("split = 'train'")).write().save(path)
    model = PipelineModel.load(path)
    return model.transform(rows).select(*fx.KEY, "split", *[F.round(names.c(n), 5).alias(names.canonical_key(n)) for n in model.stages[0].features])


register("prepared_by_saved_pipeline", reloaded, SQL["prepared_without_leak"])


def split_integrity(spark, sf):
    rows = fx.features(spark, sf, key=True).withColumn("split", F.when(F.col("l_orderkey") % 5 == 0, "test").otherwise("train"))
    model = FlowPreparer(fx.LIVE, correlation=None).fit(rows.where("split = 'train'"))
    return model.transform(rows).groupBy("split").agg(F.count("*").alias("rows"), quality.null_cell_total(rows, fx.LIVE[:1]).alias("missing"))


register("prepared_split_integrity", split_integrity, sql(["features"], "SELECT CASE WHEN l_orderkey % 5 = 0 THEN 'test' ELSE 'train' END AS split, count(*) AS rows, CAST(0 AS BIGINT) AS missing FROM features GROUP BY 1"))

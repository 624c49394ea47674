"""Scored flows, analyst aggregates, contributions and the streaming forms."""

from __future__ import annotations

from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from tidewatch import config
from tidewatch.functions import verdict
from tidewatch.operators import attribution, drift, scaling, scoring
from tidewatch.session import shared_dir
from tidewatch.sources import flows as sources
from tidewatch.sources import sinks
from tidewatch.streaming import feed

from . import fixtures as fx
from .fixtures import quoted, sql

QUERIES, SQL = {}, {}


def register(name, fn, oracle):
    QUERIES[name] = fn
    if oracle:
        SQL[name] = oracle


# verdicts ---------------------------------------------------------------------------

register(
    "verdict_rows",
    lambda s, d: fx.scored(s, d).select("event_id", "prediction", F.round("confidence", 6).alias("confidence"), "is_attack", "truth",
                                        F.col("probabilities")["DoS"].alias("p_dos"), (F.col("truth") == F.col("prediction")).alias("correct")),
    sql(["scored"], "SELECT event_id, prediction, round(confidence, 6) AS confidence, is_attack, truth, round(p1, 6) AS p_dos, truth = prediction AS correct FROM scored"),
)
register("verdict_threats", lambda s, d: scoring.threats(fx.scored(s, d)).select("event_id", "prediction"), sql(["scored"], "SELECT event_id, prediction FROM scored WHERE is_attack"))
register(
    "verdict_sides",
    lambda s, d: fx.scored(s, d).groupBy(F.when(verdict.is_attack(F.col("label_class")), "attack").otherwise("benign").alias("side")).agg(F.count("*").alias("rows")),
    sql(["scored"], "SELECT CASE WHEN label_class <> 'BENIGN' THEN 'attack' ELSE 'benign' END AS side, count(*) AS rows FROM scored GROUP BY 1"),
)
register("class_breakdown", lambda s, d: scoring.class_breakdown(fx.scored(s, d)),
         sql(["scored"], "SELECT c.class_id, c.label_class, count(s.event_id) AS n FROM classes c LEFT JOIN scored s ON s.prediction = c.label_class GROUP BY 1, 2"))
register("class_breakdown_nonzero", lambda s, d: scoring.nonzero_classes(scoring.class_breakdown(fx.scored(s, d).withColumn("prediction", F.expr("CASE WHEN prediction = 'Botnet' THEN 'BENIGN' ELSE prediction END")))),
         sql(["scored"], "SELECT c.class_id, c.label_class, count(*) AS n FROM classes c JOIN scored s ON CASE WHEN s.prediction = 'Botnet' THEN 'BENIGN' ELSE s.prediction END = c.label_class GROUP BY 1, 2"))
register("attack_totals", lambda s, d: scoring.attack_totals(fx.scored(s, d)),
         sql(["scored"], """SELECT n AS total_connections, a AS total_attacks, n - a AS total_benign, CAST(a AS DOUBLE) / n AS attack_rate,
 CASE WHEN CAST(a AS DOUBLE) / n >= 0.2 THEN 'HIGH' WHEN CAST(a AS DOUBLE) / n >= 0.05 THEN 'MEDIUM' ELSE 'LOW' END AS threat_level FROM (SELECT count(*) AS n, count(*) FILTER (is_attack) AS a FROM scored)"""))
_bins = "bins(bin, bucket, lo, hi) AS (VALUES " + ", ".join(f"({i}, '{verdict.bin_label(a, b)}', CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))" for i, (a, b) in enumerate(config.CONFIDENCE_BINS)) + ")"
register("confidence_histogram", lambda s, d: scoring.confidence_histogram(fx.scored(s, d)),
         sql(["scored"], "SELECT bin, bucket, count(event_id) AS count FROM bins LEFT JOIN scored ON confidence >= lo AND confidence < hi GROUP BY 1, 2", [_bins]))
register("truth_accuracy", lambda s, d: fx.rounded(scoring.accuracy(fx.scored(s, d)), ["accuracy"]),
         sql(["scored"], "SELECT round(avg(CAST(truth = prediction AS INT)), 6) AS accuracy, count(truth) AS scored FROM scored"))


def dataset_profile(spark, sf):
    p = scoring.dataset_profile(fx.unscored(spark, sf))
    return p.select("total_flows", "labelled", "attack_rate", F.explode("class_counts").alias("label_class", "rows"))


register("dataset_profile", dataset_profile, sql(["scored"], """SELECT t.n AS total_flows, true AS labelled, CAST(t.h AS DOUBLE) / t.n AS attack_rate, truth AS label_class, count(*) AS rows
FROM scored, (SELECT count(*) AS n, count(*) FILTER (truth <> 'BENIGN') AS h FROM scored) t WHERE truth IS NOT NULL GROUP BY 1, 2, 3, 4"""))
register("most_suspicious", lambda s, d: scoring.top_suspicious(fx.scored(s, d), "event_id").select("event_id", "prediction", "confidence"),
         sql(["scored"], "SELECT event_id, prediction, round(confidence, 4) AS confidence FROM scored WHERE is_attack ORDER BY round(confidence, 4) DESC, event_id LIMIT 10"))
register("flow_page", lambda s, d: scoring.page(scoring.threats(fx.scored(s, d)), "event_id", 3).select("event_id", "prediction"),
         sql(["scored"], "SELECT event_id, prediction FROM scored WHERE is_attack ORDER BY event_id LIMIT 20 OFFSET 60"))
register(
    "rows_returned",
    lambda s, d: scoring.first_rows(fx.scored(s, d), "event_id", 5000).select("event_id", "prediction").crossJoin(
        F.broadcast(fx.scored(s, d).agg((F.count("*") > 5000).alias("truncated")))),
    sql(["scored"], "SELECT event_id, prediction, (SELECT count(*) > 5000 FROM scored) AS truncated FROM scored ORDER BY event_id LIMIT 5000"),
)
register(
    "class_probabilities_ranked",
    lambda s, d: scoring.ranked_probabilities(fx.scored(s, d), ["event_id"]),
    sql(["scored"], "SELECT event_id, CAST(r AS INTEGER) AS rank, label_class, probability FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY probability DESC, label_class) AS r FROM ("
        + " UNION ALL ".join(f"SELECT event_id, {quoted(n)} AS label_class, round(p{k}, 6) AS probability FROM scored" for k, n in enumerate(config.CLASSES)) + ")) WHERE r <= 4 OR probability >= 0.001"),
)
_shown = "SELECT truth, event_id, prediction, round(confidence, 6) AS confidence, verified AND truth = prediction AS correctly_classified FROM"
register(
    "representative_flows",
    lambda s, d: scoring.representatives(fx.scored(s, d), "event_id").select("truth", "event_id", "prediction", F.round("confidence", 6).alias("confidence"), "correctly_classified"),
    sql(["scored"], f"""{_shown} (SELECT *, row_number() OVER (PARTITION BY truth ORDER BY confidence DESC, event_id) AS r FROM
 (SELECT *, count(*) FILTER (truth = prediction) OVER (PARTITION BY truth) >= CASE WHEN truth = 'BENIGN' THEN 2 ELSE 1 END AS verified FROM scored WHERE truth IS NOT NULL)
 WHERE NOT verified OR truth = prediction) WHERE r <= CASE WHEN truth = 'BENIGN' THEN 2 ELSE 1 END"""),
)
GROUPS = [("baseline", ["BENIGN"]), ("volumetric", ["DDoS", "DoS"]), ("targeted", ["PortScan", "BruteForce", "Botnet", "WebAttack"])]
_groups = "grp(sample_type, class_rank, truth) AS (VALUES " + ", ".join(f"('{g}', {i}, '{n}')" for g, names in GROUPS for i, n in enumerate(names)) + ")"
register(
    "first_correct_by_group",
    lambda s, d: scoring.first_correct_per_group(fx.scored(s, d), "event_id", GROUPS).select("sample_type", "truth", "event_id"),
    sql(["scored"], "SELECT sample_type, truth, event_id FROM (SELECT g.sample_type, s.truth, s.event_id, row_number() OVER (PARTITION BY g.sample_type ORDER BY class_rank, event_id) AS r FROM scored s JOIN grp g ON g.truth = s.truth WHERE s.truth = s.prediction) WHERE r = 1", [_groups]),
)
_PARAMS = scaling.Parameters(["value"], {"value": 1.0}, {"value": 0.0}, {"value": 1.0})
register(
    "scoring_contract",
    lambda s, d: scoring.contract_violations(fx.scored(s, d), _PARAMS.to_df(s), ["value"]),
    sql(["scored"], "SELECT check_name AS \"check\", violations FROM (SELECT 'probabilities_sum_to_one' AS check_name, count(*) FILTER (NOT abs(p0+p1+p2+p3+p4+p5+p6+p7 - 1) < 1e-4) AS violations FROM scored"
        " UNION ALL SELECT 'prediction_in_taxonomy', count(*) FILTER (prediction NOT IN (SELECT label_class FROM classes)) FROM scored"
        + "".join(f" UNION ALL SELECT '{n}', 0" for n in ("probability_width", "parameter_order", "fill_present", "class_ids_unique")) + ")"),
)

# contributions of a linear scorer -------------------------------------------------------

_EXPR = {"duration": "value", "packets": "CAST(user_id AS DOUBLE)", "bytes": "CAST(event_id % 1000 AS DOUBLE)", "flags": "CAST(event_id % 7 AS DOUBLE)"}
_FEATS = list(_EXPR)
_W = {(k, f): float((k * 7 + i * 3) % 11 - 5) for k in range(3) for i, f in enumerate(_FEATS)}
_MEANS = {"duration": 50.0, "packets": 75.0, "bytes": 500.0, "flags": 3.0}


def _cells(spark, sf):
    rows = fx.table(spark, sf, "events").selectExpr("event_id AS row_id", "user_id", *[f"{e} AS {f}" for f, e in _EXPR.items()])
    return rows.select("row_id", "user_id", F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("value")) for f in _FEATS])))


def _model_tables(spark):
    w = spark.createDataFrame([(config.CLASSES[k], f, v) for (k, f), v in _W.items()], "label_class string, feature string, w double")
    return w, spark.createDataFrame(list(_MEANS.items()), "feature string, mean double")


def _contributions(spark, sf):
    w, m = _model_tables(spark)
    return attribution.linear_contributions(_cells(spark, sf), w, m, "row_id", len(_FEATS), 3)


_lin = [
    "cells AS (" + " UNION ALL ".join(f"SELECT event_id AS row_id, user_id, '{f}' AS feature, {e} AS value FROM events" for f, e in _EXPR.items()) + ")",
    "w(label_class, feature, w, mean) AS (VALUES " + ", ".join(f"('{config.CLASSES[k]}', '{f}', CAST({v} AS DOUBLE), CAST({_MEANS[f]} AS DOUBLE))" for (k, f), v in _W.items()) + ")",
    "lin AS (SELECT row_id, user_id, label_class, feature, value, w * (value - mean) AS contribution FROM cells JOIN w USING (feature))",
]
register("contributions_linear", lambda s, d: _contributions(s, d).groupBy("label_class", "feature").agg(F.count("*").alias("n"), F.round(F.sum("contribution"), 2).alias("total")),
         sql([], "SELECT label_class, feature, count(*) AS n, round(sum(contribution), 2) AS total FROM lin GROUP BY 1, 2", _lin))


def _in_rows(spark, sf):
    """Values and, per class, contributions of every row as arrays: nothing is shuffled."""
    rows = fx.table(spark, sf, "events").select(F.col("event_id").alias("row_id"), "user_id", F.array(*[F.expr(e).cast("double") for e in _EXPR.values()]).alias("v"))
    return rows.withColumn("s", attribution.linear_rows(F.col("v"), [[_W[k, f] for f in _FEATS] for k in range(3)], list(_MEANS.values())))


def top_three(spark, sf):
    each = _in_rows(spark, sf).select("row_id", F.posexplode("s").alias("k", "c"))
    return each.select("row_id", F.get(F.array(*[F.lit(n) for n in config.CLASSES]), F.col("k")).alias("label_class"), F.inline(scoring.top_in_row(F.col("c"), _FEATS, 3))).withColumn("contribution", F.round("contribution", 6))


register("contributions_top_three", top_three,
         sql([], "SELECT row_id, label_class, feature, round(contribution, 6) AS contribution, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY row_id, label_class ORDER BY abs(contribution) DESC, feature) AS r FROM lin) WHERE r <= 3", _lin))
register("contributions_global", lambda s, d: fx.rounded(scoring.global_attribution(_contributions(s, d)), ["mean_abs"], 4),
         sql([], "SELECT feature, round(avg(abs(contribution)), 4) AS mean_abs FROM lin GROUP BY 1", _lin))
register("contributions_global_ranked", lambda s, d: scoring.top_global(scoring.global_attribution(_contributions(s, d)), 3).select("feature", "rank"),
         sql([], "SELECT feature, CAST(row_number() OVER (ORDER BY m DESC, feature) AS INTEGER) AS rank FROM (SELECT feature, avg(abs(contribution)) AS m FROM lin GROUP BY 1) ORDER BY m DESC, feature LIMIT 3", _lin))


_PREDICTED = "CASE WHEN user_id % 3 = 0 THEN 'BENIGN' WHEN user_id % 3 = 1 THEN 'DoS' ELSE 'DDoS' END"


def explained(spark, sf):
    """Verdict, contributions to its class and raw values joined on (row, feature)."""
    cells = _cells(spark, sf)
    verdicts = fx.table(spark, sf, "events").selectExpr("event_id AS row_id", f"{_PREDICTED} AS prediction").withColumn("is_attack", verdict.is_attack(F.col("prediction")))
    parts = _contributions(spark, sf).join(verdicts.select("row_id", F.col("prediction").alias("label_class")), ["row_id", "label_class"]).drop("label_class")
    out = scoring.explain_long(verdicts, parts, cells.drop("user_id"), "row_id", 3)
    return out.select("row_id", "feature", F.round("value", 6).alias("value"), "prediction", "increases_threat", verdict.direction_text(F.col("increases_threat")).alias("direction"))


_raises = "CASE WHEN user_id % 3 = 0 THEN contribution < 0 ELSE contribution > 0 END"
_explained_sql = sql([], f"""SELECT row_id, feature, round(value, 6) AS value, {_PREDICTED} AS prediction, {_raises} AS increases_threat,
 CASE WHEN {_raises} THEN 'increases threat' ELSE 'decreases threat' END AS direction
FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY abs(contribution) DESC, feature) AS r FROM lin WHERE label_class = {_PREDICTED}) WHERE r <= 3""", _lin)
register("contributions_explained", explained, _explained_sql)


def explained_in_row(spark, sf):
    """The same from row arrays, without a join."""
    rows = _in_rows(spark, sf).withColumn("prediction", F.expr(_PREDICTED)).withColumn("is_attack", verdict.is_attack(F.col("prediction")))
    own = F.get(F.col("s"), F.array_position(F.array(*[F.lit(n) for n in config.CLASSES[:3]]), F.col("prediction")).cast("int") - 1)
    value = F.create_map(*[x for i, f in enumerate(_FEATS) for x in (F.lit(f), F.col("v")[i])])
    top = rows.select("row_id", "prediction", "is_attack", value.alias("value"), F.inline(scoring.top_in_row(own, _FEATS, 3)))
    raises = verdict.increases_threat(F.col("contribution"), F.col("is_attack"))
    return top.select("row_id", "feature", F.round(F.element_at("value", F.col("feature")), 6).alias("value"), "prediction", raises.alias("increases_threat"), verdict.direction_text(raises).alias("direction"))


register("contributions_explained_in_row", explained_in_row, _explained_sql)


def _explained_rows(spark, sf):
    """Row-local explanations next to the verdicts: whole-number values and contributions."""
    feats = ["alpha", "beta", "gamma", "delta"]
    values = [F.expr(e).cast("double") for e in ("event_id % 7", "user_id % 11", "event_id % 5", "user_id % 3")]
    contributions = F.array(*[v - F.lit(float(m)) for v, m in zip(values, (3, 5, 2, 1))])
    rows = fx.scored(spark, sf).withColumn("v", F.array(*values)).withColumn("s", contributions)
    return rows.withColumn("top_features", scoring.top_features(F.col("s"), F.col("v"), feats, F.col("is_attack")))


_feat_rows = [
    "fr AS (SELECT event_id, prediction, confidence, is_attack, i, feature, v, v - m AS s FROM scored, LATERAL (VALUES (0, 'alpha', event_id % 7, 3), (1, 'beta', user_id % 11, 5), (2, 'gamma', event_id % 5, 2), (3, 'delta', user_id % 3, 1)) t(i, feature, v, m))",
    "top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY abs(s) DESC, i) AS r FROM fr) WHERE r <= 3)",
]
register(
    "flagged_flows",
    lambda s, d: scoring.flagged_rows(_explained_rows(s, d), "event_id"),
    sql(["scored"], "SELECT event_id AS flow_id, prediction AS predicted_class, round(confidence, 4) AS confidence, string_agg(concat(feature, '=', v, '.0'), '; ' ORDER BY r) AS top_features FROM top WHERE is_attack GROUP BY 1, 2, 3", _feat_rows),
)


def flagged_file(spark, sf):
    path = shared_dir(spark, "flagged")
    sinks.write_flagged(_explained_rows(spark, sf), path, "event_id")
    return spark.read.csv(path, header=True, schema="flow_id bigint, predicted_class string, confidence double, top_features string")


register("flagged_flows_file", flagged_file, SQL["flagged_flows"])
register(
    "verdict_sentences",
    lambda s, d: _explained_rows(s, d).select("event_id", verdict.rationale(F.col("prediction"), F.lit(0.875), F.col("top_features")).alias("sentence")),
    sql(["scored"], """SELECT event_id, concat('Classified ', any_value(prediction), ' at 87.5% confidence, driven by ', string_agg(concat(feature, ' (', v, '.0)'), ', ' ORDER BY r), '.') AS sentence
FROM (SELECT *, count(*) FILTER (raises) OVER (PARTITION BY event_id) AS k FROM (SELECT *, CASE WHEN is_attack THEN s > 0 ELSE s < 0 END AS raises FROM top)) WHERE k = 0 OR raises GROUP BY event_id""", _feat_rows),
)

# streaming ------------------------------------------------------------------------------

def _feed(spark, sf):
    schema = fx.table(spark, sf, "events").schema
    return sources.read_feed(spark, sf, schema, files_per_trigger=1, pattern="events.parquet")


def _scored_feed(spark, sf):
    rows = _feed(spark, sf).selectExpr(*[f"{e} AS {n}" for n, e in fx.FLOW_COLUMNS.items()])
    labelled = fx.encode_labels(fx.map_labels_strict(rows, "label_text"), out="class_id")
    return feed.score_feed(fx.with_rule_probs(fx.resolve_truth(labelled, "truth_text"))).withColumn("ts", F.col("ts").cast("timestamp"))


_LEVEL = "CASE WHEN {r} >= 0.2 THEN 'HIGH' WHEN {r} >= 0.05 THEN 'MEDIUM' ELSE 'LOW' END"


def _flat_stats(df):
    return df.select("session", "flows", "attacks", "benign", "attack_rate", "threat_level", "labelled", "correct",
                     "accuracy", *[F.col("by_class")[n].alias(f"n_{n.lower()}") for n in config.CLASSES])


_stats_sql = lambda key: f"""SELECT session, n AS flows, a AS attacks, n - a AS benign, CAST(a AS DOUBLE) / n AS attack_rate, {_LEVEL.format(r='CAST(a AS DOUBLE) / n')} AS threat_level, l AS labelled, c AS correct,
 CAST(c AS DOUBLE) / l AS accuracy, {', '.join(f'n_{n.lower()}' for n in config.CLASSES)} FROM (SELECT {key} AS session, count(*) AS n, count(*) FILTER (is_attack) AS a, count(truth) AS l, count(*) FILTER (truth = prediction) AS c,
 {', '.join(f"count(*) FILTER (prediction = '{n}') AS n_{n.lower()}" for n in config.CLASSES)} FROM scored GROUP BY 1)"""  # noqa: E731
register("stream_session_totals", lambda s, d: _flat_stats(feed.drain_complete(feed.session_stats(_scored_feed(s, d)))), sql(["scored"], _stats_sql("'all'")))
register(
    "stream_totals_by_user",
    lambda s, d: _flat_stats(feed.drain_complete(feed.session_stats(_scored_feed(s, d), ["user_id"])).withColumnRenamed("user_id", "session")),
    sql(["scored"], _stats_sql("user_id")),
)


def _files_feed(spark, sf, columns):
    """Scored flows from four files, one a batch, as they arrive in two lots: (first lot, second lot, the stream)."""
    rows = fx.scored(spark, sf).select(*columns)
    folder = shared_dir(spark, "files")
    lot = lambda k: rows.where(F.col("event_id") % 2 == k).repartition(2, "event_id").write.mode("append").parquet(folder)
    return lambda: lot(0), lambda: lot(1), lambda: sources.read_feed(spark, folder, rows.schema, files_per_trigger=1)


def _killed_and_resumed(spark, sf, columns, shape, keys):
    """A feed whose second batch fails after its write, that is started again, and again when more files have come."""
    first, second, stream = _files_feed(spark, sf, columns)
    table, mark = feed.LatestByKey(spark, shared_dir(spark, "latest"), keys, every=2), shared_dir(spark, "mark")
    failed = []

    def handler(batch, batch_id):
        table(batch, batch_id)
        if batch_id == 1 and not failed:
            failed.append(batch_id)
            raise RuntimeError("the batch is lost after its write")

    run = lambda: feed.drain_from(shape(stream()).writeStream.outputMode("update").foreachBatch(handler), mark)
    first()
    try:
        run()
    except StreamingQueryException:
        run()
    second()
    run()
    return table


_SCORED = ["event_id", "user_id", "prediction", "is_attack", "truth"]
register(
    "stream_totals_upserted",
    lambda s, d: _flat_stats(_killed_and_resumed(s, d, _SCORED, lambda rows: feed.session_stats(rows, ["user_id"]), ["user_id"]).current().withColumnRenamed("user_id", "session")),
    sql(["scored"], _stats_sql("user_id")),
)


def recent_of_users(spark, sf):
    """The five newest flows of every user, out of the query's own state."""
    table = _killed_and_resumed(spark, sf, _SCORED, lambda rows: feed.recent_by_session(rows.drop("truth"), ["user_id"], "event_id", 5), ["user_id"])
    return feed.recent_rows(table, "event_id long, prediction string, is_attack boolean")


register("stream_recent_by_user", recent_of_users, sql(["scored"], """SELECT user_id, event_id, prediction, is_attack FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM scored) WHERE r <= 5"""))


def scored_batches(spark, sf):
    path = shared_dir(spark, "scored")
    feed.drain_to_batches(_scored_feed(spark, sf).select("event_id", "prediction", "is_attack"), feed.batch_sink(path))
    return spark.read.parquet(path).drop("batch")


register("stream_scored_flows", scored_batches, sql(["scored"], "SELECT event_id, prediction, is_attack FROM scored"))


def stream_timeline(spark, sf):
    """Minute buckets, since the given feed has about one flow every few minutes."""
    counts = feed.drain_complete(feed.timeline(_scored_feed(spark, sf), width="1 hour", late="10 seconds"))
    return counts.select(F.col("bucket").cast("timestamp_ntz").alias("bucket"), "benign", "attacks")


_buckets = "b AS (SELECT date_trunc('hour', ts) AS bucket, count(*) FILTER (NOT is_attack) AS benign, count(*) FILTER (is_attack) AS attacks FROM scored GROUP BY 1)"
register("stream_timeline", stream_timeline, sql(["scored"], "SELECT * FROM b", [_buckets]))
register(
    "timeline_recent",
    lambda s, d: feed.trim_timeline(feed.timeline(fx.scored(s, d), width="1 hour")).withColumn("bucket", F.col("bucket").cast("timestamp_ntz")),
    sql(["scored"], "SELECT * FROM b WHERE bucket > (SELECT min(bucket) FROM b) AND bucket < (SELECT max(bucket) FROM b) ORDER BY bucket DESC LIMIT 40", [_buckets]),
)
register(
    "timeline_by_second",
    lambda s, d: feed.timeline(fx.scored(s, d)).withColumn("bucket", F.date_trunc("second", "bucket").cast("timestamp_ntz")),
    sql(["scored"], "SELECT date_trunc('second', ts) AS bucket, count(*) FILTER (NOT is_attack) AS benign, count(*) FILTER (is_attack) AS attacks FROM scored GROUP BY 1"),
)


def _recent(spark, sf):
    keeper = feed.RecentFlows(spark, shared_dir(spark, "recent"), "event_id")
    feed.drain_to_batches(_scored_feed(spark, sf).select("event_id", "prediction", "is_attack"), keeper)
    return keeper


register("stream_recent_flows", lambda s, d: _recent(s, d).current().drop("batch"), sql(["scored"], "SELECT event_id, prediction, is_attack FROM scored ORDER BY event_id DESC LIMIT 250"))
register("stream_latest_attacks", lambda s, d: _recent(s, d).latest_attacks().select("event_id", "prediction"),
         sql(["scored"], "SELECT event_id, prediction FROM (SELECT * FROM scored ORDER BY event_id DESC LIMIT 250) WHERE is_attack ORDER BY event_id DESC LIMIT 5"))
register(
    "running_totals",
    lambda s, d: feed.running_totals(fx.scored(s, d), "event_id"),
    sql(["scored"], """SELECT event_id, flows, attacks, labelled, correct, CAST(attacks AS DOUBLE) / flows AS attack_rate, CASE WHEN labelled > 0 THEN CAST(correct AS DOUBLE) / labelled END AS accuracy FROM (
 SELECT event_id, count(*) OVER w AS flows, count(*) FILTER (is_attack) OVER w AS attacks, count(truth) OVER w AS labelled, count(*) FILTER (truth = prediction) OVER w AS correct FROM scored WINDOW w AS (ORDER BY event_id ROWS UNBOUNDED PRECEDING))"""),
)


def stream_drift(spark, sf):
    """Drift of the arriving flows against the first half of the users."""
    reference = fx.table(spark, sf, "events").where("user_id % 2 = 0").selectExpr("value", "CAST(user_id AS DOUBLE) AS user_id")
    arriving = _feed(spark, sf).where("user_id % 2 = 1").selectExpr("value * 2 AS value", "CAST(user_id AS DOUBLE) AS user_id")
    path = shared_dir(spark, "drift")
    feed.drain_to_batches(arriving, feed.drift_sink(reference, ["value", "user_id"], path))
    return spark.read.parquet(path).drop("batch")


def _w(col, a, b):
    """Normalised distance of one column between two event subsets, in SQL."""
    return f"""(SELECT coalesce(sum(abs(cr / nr - cc / nc) * (nx - x)), 0) / any_value(sp) AS s FROM (SELECT x, sum(r) OVER w AS cr, sum(c) OVER w AS cc, lead(x) OVER (ORDER BY x) AS nx FROM
 (SELECT x, CAST(sum(r) AS DOUBLE) AS r, CAST(sum(c) AS DOUBLE) AS c FROM (SELECT {a} AS x, 1 AS r, 0 AS c FROM events WHERE user_id % 2 = 0 UNION ALL SELECT {b}, 0, 1 FROM events WHERE user_id % 2 = 1) GROUP BY 1) WINDOW w AS (ORDER BY x ROWS UNBOUNDED PRECEDING)),
 (SELECT CAST(count(*) FILTER (user_id % 2 = 0) AS DOUBLE) AS nr, CAST(count(*) FILTER (user_id % 2 = 1) AS DOUBLE) AS nc, stddev_pop({a}) FILTER (user_id % 2 = 0) AS sp FROM events))"""


register("stream_drift", stream_drift, f"""SELECT count(*) AS n_features, count(*) FILTER (s > 0.1) AS n_drifted_features, avg(CAST(s > 0.1 AS INT)) AS drift_share, avg(CAST(s > 0.1 AS INT)) > 0.2 AS drift_detected
FROM (SELECT s FROM {_w('value', 'value', 'value * 2')} UNION ALL SELECT s FROM {_w('user_id', 'user_id', 'user_id')})""")

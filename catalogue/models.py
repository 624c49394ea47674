"""Model fits, scoring, feature sets and attributions on the given tables.

Fits depend on MLlib's own sampling, so SQL cannot repeat a score. The queries return
facts that hold for every row of any sound fit, and SQL states those.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewatch.operators import attribution
from tidewatch.operators.sampling import train_test_split
from tidewatch.operators.scaling import Parameters, apply_scaler, fit_fills, fit_scaler
from tidewatch.plans import analysis, training
from tidewatch.session import shared_dir
from tidewatch.sources import sinks

from . import fixtures as fx

QUERIES, SQL = {}, {}

EMBEDDED = [f"dim {i}" for i in range(64)]
LABELS = {f"group {k}": k for k in range(10)}
FLOW_FEATURES = ["Flow Bytes/s", "Idle.Mean", "Subflow Fwd", "Active Std", "Fwd Seg"]


def register(name, fn, oracle=None):
    QUERIES[name] = fn
    if oracle:
        SQL[name] = oracle


def _stored(ready):
    """Prepared tables are written before a fit, which reads its input many times."""
    path = shared_dir(ready.sparkSession, "prepared")
    sinks.write_splits(ready, path)
    return ready.sparkSession.read.parquet(path)


def embedded(spark, sf):
    """The embedding table as 64 named features and ten classes, split by class."""
    rows = fx.table(spark, sf, "embeddings").select(
        "vec_id", F.col("label").alias("label_int"), F.concat(F.lit("group "), F.col("label").cast("string")).alias("label_class"),
        *[F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate(EMBEDDED)])
    return _stored(train_test_split(rows, "label_class", ["vec_id"], strata=len(LABELS)))


def flow_rows(spark, sf):
    """The labelled feed with five numeric features."""
    rows = fx.unscored(spark, sf).select(
        "event_id", "label_class", F.col("class_id").alias("label_int"), "truth", F.col("value").alias("Flow Bytes/s"),
        (F.col("event_id") % 17).cast("double").alias("Idle.Mean"), F.col("user_id").cast("double").alias("Subflow Fwd"),
        F.sqrt(F.abs("value")).alias("Active Std"), (F.col("user_id") % 7).cast("double").alias("Fwd Seg"))
    return _stored(train_test_split(rows, "label_class", ["event_id"], strata=8))


def _sides(rows):
    return rows.where("split = 'train'"), rows.where("split = 'test'")


def _row_facts(scored):
    total = F.aggregate("probs", F.lit(0.0), lambda a, x: a + x)
    return scored.select(
        "vec_id", "label_class", F.col("prediction").isin(list(LABELS)).alias("known"), (F.abs(total - 1) < 1e-6).alias("sums_to_one"),
        (F.col("confidence") == F.array_max("probs")).alias("confident"))


def _scored(fit, **args):
    """Every row scored by a fit on the train rows, and what holds for any sound scores.

    How often the test rows are right is not among the facts: on the given embeddings the
    fits do not beat the largest class.
    """

    def run(spark, sf):
        rows = embedded(spark, sf)
        model = fit(rows.where("split = 'train'"), EMBEDDED, classes=10, **args)
        return _row_facts(training.score(rows, model, EMBEDDED, list(LABELS)))

    return run


_row_sql = "SELECT vec_id, 'group ' || label AS label_class, true AS known, true AS sums_to_one, true AS confident FROM embeddings"
register("forest_scores", _scored(training.fit_forest, trees=20, depth=8), _row_sql)
register("boosted_scores", _scored(training.fit_boosted, rounds=3, depth=3), _row_sql)
register("network_scores", _scored(training.fit_network, hidden=[32, 16], epochs=30), _row_sql)


def feature_ranking(spark, sf):
    train, _ = _sides(flow_rows(spark, sf))
    model = training.fit_forest(train, FLOW_FEATURES, trees=20, depth=8)
    ranked = training.rank_features(spark, FLOW_FEATURES, training.importances(model))
    # one row per feature
    best_first = Window.partitionBy(F.lit(0)).orderBy(F.desc("importance"), "pos")
    return ranked.select("pos", "feature", (F.col("rank") == F.row_number().over(best_first)).alias("in_order"), F.col("importance").between(0.0, 1.0).alias("share"))


register("feature_ranking", feature_ranking,
         " UNION ALL ".join(f"SELECT {i} AS pos, '{n}' AS feature, true AS in_order, true AS share" for i, n in enumerate(FLOW_FEATURES)))


def feature_set_comparison(spark, sf):
    train, test = _sides(flow_rows(spark, sf))
    scores = training.importances(training.fit_forest(train, FLOW_FEATURES, trees=10, depth=6))
    sets = training.feature_sets(FLOW_FEATURES[:4], scores[:4], FLOW_FEATURES, ks=(2, 3))
    out = training.feature_experiment(train, test, sets, fx.config.CLASS_IDS, "random_forest", trees=10, depth=6)
    # one row per feature set
    better = F.max("macro_f1").over(Window.partitionBy(F.lit(0)).orderBy(F.desc("macro_f1"), "ord").rowsBetween(1, Window.unboundedFollowing))
    held = test.agg(F.count("*").alias("held"))
    return out.crossJoin(F.broadcast(held)).select(
        "feature_set", "feature_count", (F.col("test_samples") == F.col("held")).alias("all_test_rows"), F.col("macro_f1").between(0.0, 1.0).alias("share"),
        (F.col("macro_f1") >= F.coalesce(better, F.lit(0.0))).alias("best_first"))


register("feature_set_comparison", feature_set_comparison, """SELECT feature_set, feature_count, true AS all_test_rows, true AS share, true AS best_first
FROM (VALUES ('Top-2 Features', 2), ('Top-3 Features', 3), ('4-Feature Set (Filtered)', 4), ('5-Feature Set (Unfiltered)', 5)) AS t(feature_set, feature_count)""")


def governed_sweep(spark, sf):
    """Three small configurations, gated one after the other."""
    train, test = _sides(flow_rows(spark, sf))
    configs = [
        {"name": "forest_small", "kind": "random_forest", "features": "full", "args": {"trees": 5, "depth": 4}},
        {"name": "forest_deep", "kind": "random_forest", "features": "full", "args": {"trees": 20, "depth": 10}},
        {"name": "forest_top3", "kind": "random_forest", "features": "top3", "args": {"trees": 10, "depth": 6}},
    ]
    ranking = training.importances(training.fit_forest(train, FLOW_FEATURES, trees=10, depth=6))
    out = training.sweep(train, test, FLOW_FEATURES, configs=configs, ranking=ranking)
    rows = [(r["config"]["name"], r["decision"]["champion"], r["decision"]["decision"], len(r["features"]), r["decision"]["macro_f1"]) for r in out]
    return spark.createDataFrame(rows, "challenger string, champion string, decision string, features int, macro_f1 double")


register("governed_sweep", governed_sweep)


def tree_attributions(spark, sf):
    """Base plus contributions next to the model's own probability, for every row."""
    rows = flow_rows(spark, sf)
    model = training.fit_forest(rows.where("split = 'train'"), FLOW_FEATURES, trees=10, depth=6)
    scored = training.score(rows, model, FLOW_FEATURES)
    k = F.array_position(F.array(*[F.lit(n) for n in fx.config.CLASSES]), F.col("prediction")) - 1
    parts = attribution.tree_contributions(scored.withColumn("predicted_id", k), model, FLOW_FEATURES, "event_id", 8)
    total = F.col("base") + F.aggregate("contribution", F.lit(0.0), lambda a, x: a + x)
    both = parts.select("event_id", total.alias("explained")).join(scored.select("event_id", "confidence"), "event_id")
    return both.select("event_id", (F.abs(F.col("explained") - F.col("confidence")) < 1e-6).alias("adds_up"))


register("tree_attributions", tree_attributions, "SELECT event_id, true AS adds_up FROM events")


def export_analysis(spark, sf):
    """Train, then analyse the whole feed as an export under odd header spellings."""
    rows = flow_rows(spark, sf)
    train, _ = _sides(rows)
    fills = fit_fills(train, FLOW_FEATURES)
    center, scale = fit_scaler(train, FLOW_FEATURES)
    params = Parameters(FLOW_FEATURES, fills, center, scale)
    model = training.fit_forest(apply_scaler(train, params), FLOW_FEATURES, trees=10, depth=6)
    export = rows.select(
        F.col("event_id").alias("flow_id"), F.col("`Flow Bytes/s`").alias("flow_bytes_s"), F.col("`Idle.Mean`").cast("string").alias("IDLE-MEAN"),
        F.col("`Subflow Fwd`").alias(" Subflow Fwd "), F.col("`Active Std`").alias("active std"), F.col("truth").alias("Label"))
    found = analysis.analyze(export, model, params, classes=fx.config.CLASS_IDS)
    classes = found["class_breakdown"].agg(
        F.count("*").alias("classes"), F.sum("n").alias("flows"), F.sum(F.when(F.col("label_class") != fx.config.BENIGN, F.col("n")).otherwise(0)).alias("attacks"))
    listed = found["rows"].agg(F.count("*").alias("listed"), F.count_if(F.size("top_features") > 0).alias("explained"))
    whole = found["summary"].crossJoin(F.broadcast(classes)).crossJoin(F.broadcast(listed))
    return whole.select("total_connections", "classes", "flows", "listed", "explained", (F.col("attacks") == F.col("total_attacks")).alias("attacks_agree"))


register("export_analysis", export_analysis,
         "SELECT count(*) AS total_connections, 8 AS classes, count(*) AS flows, count(*) AS listed, count(*) AS explained, true AS attacks_agree FROM events")

"""Fits, attributions and analyses on flows whose class follows a rule, so SQL knows every answer.

A flow is BENIGN where event_id % 17 >= 6; the others are DoS where user_id % 7 >= 3, else DDoS.
Row weights are balanced, so a tree of two levels has shares that no table changes: a third
of each class at its root, halves of the two attack classes below the first split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.operators import attribution
from tidewatch.operators.sampling import train_test_split
from tidewatch.operators.scaling import Parameters, apply_scaler, fit_fills, fit_scaler
from tidewatch.plans import analysis, training
from tidewatch.plans.record import SweepRecord
from tidewatch.session import shared_dir

from . import fixtures as fx
from .models import _stored

QUERIES, SQL = {}, {}

FEATURES = ["Flow Bytes/s", "Idle.Mean", "Subflow Fwd", "Active Std", "Fwd Seg"]
VALUES = ["value", "event_id % 17", "user_id % 7", "sqrt(abs(value))", "event_id % 5"]
RULED = "CASE WHEN event_id % 17 >= 6 THEN 'BENIGN' WHEN user_id % 7 >= 3 THEN 'DoS' ELSE 'DDoS' END"
_ruled = f"ruled AS (SELECT event_id, {RULED} AS prediction FROM events)"


def register(name, fn, oracle=None):
    QUERIES[name] = fn
    if oracle:
        SQL[name] = oracle


def ruled(spark, sf) -> DataFrame:
    """All events as five features and the class of the rule, split by class."""
    rows = fx.table(spark, sf, "events").select(
        "event_id", F.expr(RULED).alias("label_class"), *[F.expr(f"cast({v} as double)").alias(n) for n, v in zip(FEATURES, VALUES)])
    rows = rows.withColumn("label_int", F.element_at(F.create_map(*[F.lit(x) for kv in fx.config.CLASS_IDS.items() for x in kv]), F.col("label_class")))
    return _stored(train_test_split(rows.withColumn("truth", F.col("label_class")), "label_class", ["event_id"], strata=3))


def _predicted(fit, **args):
    """Every row's predicted class, from a fit on the train rows."""

    def run(spark, sf):
        rows = ruled(spark, sf)
        model = fit(rows.where("split = 'train'"), FEATURES, classes=3, **args)
        return training.score(rows, model, FEATURES).select("event_id", "prediction")

    return run


_rule_sql = f"WITH {_ruled} SELECT * FROM ruled"
register("forest_predictions", _predicted(training.fit_forest, trees=20, depth=10), _rule_sql)
register("boosted_predictions", _predicted(training.fit_boosted, rounds=6, depth=3), _rule_sql)


def network_accuracy(spark, sf):
    """Held-out accuracy of the network by class, against a bound that no constant answer passes."""
    rows = ruled(spark, sf)
    train = rows.where("split = 'train'")
    center, scale = fit_scaler(train, FEATURES, "standard")
    params = Parameters(FEATURES, dict.fromkeys(FEATURES, 0.0), center, scale)
    model = training.fit_network(apply_scaler(train, params), FEATURES, classes=3, hidden=[16], epochs=150)
    held = training.score(apply_scaler(rows.where("split = 'test'"), params), model, FEATURES)
    return held.groupBy("label_class").agg((F.avg((F.col("prediction") == F.col("label_class")).cast("int")) >= 0.9).alias("learned"))


register("network_accuracy", network_accuracy, f"WITH {_ruled} SELECT DISTINCT prediction AS label_class, true AS learned FROM ruled")


def one_tree(rows, features=FEATURES):
    return training.fit_forest(rows.where("split = 'train'"), features, classes=3, trees=1, depth=2, bootstrap=False)


def _with_id(scored):
    return scored.withColumn("predicted_id", F.array_position(F.array(*[F.lit(n) for n in fx.config.CLASSES]), F.col("prediction")) - 1)


def attribution_rows(spark, sf):
    """Each row's credits for its predicted class, and their sizes over the classes, next to the shares of the rule."""
    rows = ruled(spark, sf)
    model = one_tree(rows)
    parts = attribution.tree_contributions(_with_id(training.score(rows, model, FEATURES)), model, FEATURES, "event_id", 8)
    cells = parts.select("event_id", "base", F.posexplode(F.arrays_zip("contribution", "all_abs")).alias("pos", "x"))
    return fx.rounded(cells.select("event_id", "pos", "base", F.col("x.contribution").alias("contribution"), F.col("x.all_abs").alias("all_abs")),
                      ["base", "contribution", "all_abs"])


_credit = """credit AS (
 SELECT event_id, prediction, pos,
  CASE WHEN pos = 1 THEN CASE WHEN prediction = 'BENIGN' THEN 2e0 / 3 ELSE 1e0 / 6 END WHEN pos = 2 AND prediction <> 'BENIGN' THEN 0.5e0 ELSE 0e0 END AS contribution,
  CASE WHEN pos = 1 THEN CASE WHEN prediction = 'BENIGN' THEN 4e0 / 3 ELSE 2e0 / 3 END WHEN pos = 2 AND prediction <> 'BENIGN' THEN 1e0 ELSE 0e0 END AS all_abs
 FROM ruled, (SELECT unnest(range(0, 5)) AS pos))"""
register("attribution_rows", attribution_rows,
         f"WITH {_ruled}, {_credit} SELECT event_id, pos, round(1e0 / 3, 6) AS base, round(contribution, 6) AS contribution, round(all_abs, 6) AS all_abs FROM credit")


def _margins(rows, model):
    """Raw score of the predicted class from the models' own transform."""
    out = training.assemble(rows, FEATURES)
    for k, member in enumerate(model.models):
        m = member.copy()
        m.setRawPredictionCol(f"raw{k}").setProbabilityCol("").setPredictionCol("")
        out = m.transform(out)
    raws = F.array(*[training.vector_to_array(f"raw{k}")[1] for k in range(len(model.models))])
    return out.select("event_id", F.get(raws, F.col("predicted_id").cast("int")).alias("raw"))


def boosted_attributions(spark, sf):
    """Base plus credits next to the boosted models' own raw score, for every row."""
    rows = ruled(spark, sf)
    model = training.fit_boosted(rows.where("split = 'train'"), FEATURES, classes=3, rounds=3, depth=3)
    scored = _with_id(training.score(rows, model, FEATURES))
    parts = attribution.tree_contributions(scored, model, FEATURES, "event_id", 3)
    total = F.col("base") + F.aggregate("contribution", F.lit(0.0), lambda a, x: a + x)
    both = parts.select("event_id", total.alias("explained")).join(_margins(scored, model), "event_id")
    return both.select("event_id", (F.abs(F.col("explained") - F.col("raw")) < 1e-9).alias("adds_up"))


register("boosted_attributions", boosted_attributions, "SELECT event_id, true AS adds_up FROM events")

GROUPS = [("baseline", ["BENIGN"]), ("volumetric", ["PortScan", "DoS", "DDoS"]), ("targeted", ["DDoS"])]


def _report(spark, sf):
    rows = ruled(spark, sf)
    model = one_tree(rows)
    return analysis.attribution_report(training.score(rows, model, FEATURES), model, FEATURES, "event_id", GROUPS)


register("attribution_summary", lambda s, d: fx.rounded(_report(s, d)["top_features"], ["mean_abs"]), f"""WITH {_ruled}, {_credit},
names(pos, feature) AS (VALUES {", ".join(f"({i}, '{n}')" for i, n in enumerate(FEATURES))}),
means AS (SELECT feature, avg(all_abs) / 8 AS mean_abs FROM credit JOIN names USING (pos) GROUP BY feature)
SELECT feature, round(mean_abs, 6) AS mean_abs, CAST(row_number() OVER (ORDER BY mean_abs DESC, feature) AS INTEGER) AS rank FROM means""")
register("attribution_examples", lambda s, d: _report(s, d)["examples"].select(
    "sample_type", "true_class", "predicted_class", F.inline(F.transform("top_features", lambda f, i: F.struct((i + 1).alias("rank"), f["feature"].alias("feature"), f["value"].alias("value"), f["shap_value"].alias("shap_value"), f["direction"].alias("direction"))))),
    f"""WITH {_ruled}, {_credit},
names(pos, feature) AS (VALUES {", ".join(f"({i}, '{n}')" for i, n in enumerate(FEATURES))}),
sample(sample_type, label_class, k) AS (VALUES {", ".join(f"('{g}', '{n}', {i})" for g, ns in GROUPS for i, n in enumerate(ns))}),
pick AS (SELECT sample_type, label_class, event_id FROM sample JOIN ruled ON label_class = prediction QUALIFY row_number() OVER (PARTITION BY sample_type ORDER BY k, event_id) = 1),
cell AS (SELECT event_id, unnest([0, 1, 2, 3, 4]) AS pos, unnest([{", ".join(f"CAST({v} AS DOUBLE)" for v in VALUES)}]) AS value FROM events)
SELECT sample_type, label_class AS true_class, label_class AS predicted_class,
 CAST(row_number() OVER (PARTITION BY sample_type ORDER BY abs(round(contribution, 9)) DESC, pos) AS INTEGER) AS rank, feature, round(value, 4) AS value, round(contribution, 6) AS shap_value,
 CASE WHEN (label_class = 'BENIGN' AND contribution < 0) OR (label_class <> 'BENIGN' AND contribution > 0) THEN 'increases threat' ELSE 'decreases threat' END AS direction
FROM pick JOIN credit USING (event_id) JOIN cell USING (event_id, pos) JOIN names USING (pos)""")


def feature_ranking_known(spark, sf):
    """Importances where one feature alone tells attacks from the rest."""
    rows = ruled(spark, sf).withColumn("label_int", (F.col("label_int") > 0).cast("int")).withColumn("label_class", F.col("label_int").cast("string"))
    model = training.fit_forest(rows.where("split = 'train'"), FEATURES, classes=2, trees=1, depth=3, bootstrap=False)
    return training.rank_features(spark, FEATURES, training.importances(model))


register("feature_ranking_known", feature_ranking_known, "SELECT * FROM (VALUES (0, 'Flow Bytes/s', 0e0, 2), (1, 'Idle.Mean', 1e0, 1), (2, 'Subflow Fwd', 0e0, 3), (3, 'Active Std', 0e0, 4), (4, 'Fwd Seg', 0e0, 5)) t(pos, feature, importance, rank) WHERE EXISTS (SELECT 1 FROM events)")


def _analysed(spark, sf):
    """The whole feed analysed as an export under odd header spellings."""
    rows = ruled(spark, sf)
    train = rows.where("split = 'train'")
    center, scale = fit_scaler(train, FEATURES)
    params = Parameters(FEATURES, fit_fills(train, FEATURES), center, scale)
    model = one_tree(apply_scaler(rows, params))
    export = rows.select(
        F.col("event_id").alias("flow_id"), F.col("`Flow Bytes/s`").alias("flow_bytes_s"), F.col("`Idle.Mean`").cast("string").alias("IDLE-MEAN"),
        F.col("`Subflow Fwd`").alias(" Subflow Fwd "), F.col("`Active Std`").alias("active std"), F.col("`Fwd Seg`").alias("fwd seg"), F.col("truth").alias("Label"))
    return analysis.analyze(export, model, params, classes=fx.config.CLASS_IDS)


register("export_analysis_rows", lambda s, d: _analysed(s, d)["rows"].select(
    F.col("flow_id"), "prediction", "confidence", "is_attack", F.inline(F.transform(F.slice("top_features", 1, 2), lambda f, i: F.struct((i + 1).alias("rank"), f["feature"].alias("feature"), f["value"].alias("value"), f["shap_value"].alias("shap_value"))))),
    f"""WITH {_ruled} SELECT event_id AS flow_id, prediction, 1e0 AS confidence, prediction <> 'BENIGN' AS is_attack, rank,
 CASE WHEN (prediction = 'BENIGN') = (rank = 1) THEN 'Idle.Mean' WHEN rank = 1 THEN 'Subflow Fwd' ELSE 'Flow Bytes/s' END AS feature,
 round(CASE WHEN (prediction = 'BENIGN') = (rank = 1) THEN event_id % 17 WHEN rank = 1 THEN user_id % 7 ELSE value END, 4) AS value,
 CASE WHEN prediction = 'BENIGN' THEN CASE WHEN rank = 1 THEN 0.666667e0 ELSE 0e0 END WHEN rank = 1 THEN 0.5e0 ELSE 0.166667e0 END AS shap_value
FROM ruled JOIN events USING (event_id), (VALUES (1), (2)) r(rank)""")


def _totals(spark, sf):
    found = _analysed(spark, sf)
    top = found["global_attribution"].agg(F.max_by("feature", "mean_abs").alias("top_feature"), F.round(F.max("mean_abs"), 6).alias("top_mean_abs"))
    return found["summary"].select("total_connections", "total_attacks", F.round("attack_rate", 6).alias("attack_rate")).crossJoin(F.broadcast(found["truth_accuracy"])).crossJoin(F.broadcast(top))


register("export_analysis_totals", _totals, f"""WITH {_ruled}, {_credit}
SELECT count(*) AS total_connections, count(*) FILTER (prediction <> 'BENIGN') AS total_attacks, round(count(*) FILTER (prediction <> 'BENIGN') / count(*), 6) AS attack_rate,
 1e0 AS accuracy, count(*) AS scored, 'Idle.Mean' AS top_feature, (SELECT round(avg(all_abs) / 8, 6) FROM credit WHERE pos = 1) AS top_mean_abs FROM ruled""")


def recorded_sweep(spark, sf):
    """A sweep that stops after a decision and before its pointer, and is started again; the log, and what is in force.

    One split cannot tell the two attack classes apart, two can, a third adds nothing, and without the feature
    that tells them apart the classes are missed again.
    """
    rows = ruled(spark, sf)
    train, test = rows.where("split = 'train'"), rows.where("split = 'test'")
    one = {"trees": 1, "bootstrap": False}
    configs = [
        {"name": "one_split", "kind": "random_forest", "features": "full", "args": one | {"depth": 1}},
        {"name": "two_splits", "kind": "random_forest", "features": "full", "args": one | {"depth": 2}},
        {"name": "three_splits", "kind": "random_forest", "features": "full", "args": one | {"depth": 3}},
        {"name": "best_feature", "kind": "random_forest", "features": "top1", "args": one | {"depth": 2}}]
    ranking = [0.0, 1.0, 0.5, 0.0, 0.0]
    path = shared_dir(spark, "sweep")

    class Stopped(SweepRecord):
        def _point(self, seq):
            raise InterruptedError("stopped before the pointer")

    try:
        training.sweep(train, test, FEATURES, configs=configs, ranking=ranking, record=Stopped(spark, path))
    except InterruptedError:
        pass
    record = SweepRecord(spark, path)
    training.sweep(train, test, FEATURES, configs=configs, ranking=ranking, record=record)
    force = record.serving().select(F.col("model").alias("in_force"), F.col("seq").alias("version"))
    return record.log().select("seq", "challenger", "champion", "decision", (F.col("challenger_metrics.macro_f1") > 0.999999).alias("all_right"),
                               F.col("champion_metrics.macro_f1").alias("champion_f1"), F.size("gates").cast("long").alias("gates")).crossJoin(F.broadcast(force))


register("recorded_sweep", recorded_sweep, """SELECT * FROM (VALUES
 (0, 'one_split', NULL, 'REJECTED', false, NULL, 3), (1, 'two_splits', NULL, 'PROMOTED', true, NULL, 3), (2, 'three_splits', 'two_splits', 'REJECTED', true, 1e0, 4),
 (3, 'best_feature', 'two_splits', 'REJECTED', false, 1e0, 4)) t(seq, challenger, champion, decision, all_right, champion_f1, gates), (SELECT 'two_splits' AS in_force, 1 AS version) WHERE EXISTS (SELECT 1 FROM events)""")

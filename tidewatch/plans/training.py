"""Model fits, scoring, feature-set experiments and the governed sweep."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.ml.classification import (
    GBTClassifier, MultilayerPerceptronClassificationModel, MultilayerPerceptronClassifier, OneVsRest, OneVsRestModel,
    RandomForestClassificationModel, RandomForestClassifier,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config
from ..functions.names import c
from ..operators.governance import against, decide, gate_metrics
from ..operators.metrics import confusion_matrix, pair_counts, per_class, settle, summary
from ..operators.scaling import with_sample_weight
from ..operators.scoring import with_verdict
from ..session import local_table
from .record import SweepRecord


def assemble(df: DataFrame, features: Sequence[str], out: str = "features") -> DataFrame:
    """Feature vector from named columns, whatever characters their names hold."""
    return df.withColumn(out, array_to_vector(F.array(*[c(f).cast("double") for f in features])))


def _training_rows(train: DataFrame, features: Sequence[str], label: str, classes: int, weighted: bool) -> DataFrame:
    rows = with_sample_weight(train, label, classes) if weighted else train
    extra = ["weight"] if weighted else []
    return assemble(rows, features).select("features", F.col(label).cast("double").alias("label"), *extra)


def fit_forest(
    train: DataFrame, features: Sequence[str], label: str = "label_int", classes: int = len(config.CLASSES),
    trees: int = 100, depth: int = 20, min_leaf: int = 2, seed: int = config.SEED, bootstrap: bool = True,
) -> RandomForestClassificationModel:
    rows = _training_rows(train, features, label, classes, True)
    return RandomForestClassifier(
        numTrees=trees, maxDepth=depth, minInstancesPerNode=min_leaf, weightCol="weight", seed=seed, bootstrap=bootstrap
    ).fit(rows)


def fit_boosted(
    train: DataFrame, features: Sequence[str], label: str = "label_int", classes: int = len(config.CLASSES),
    rounds: int = 200, depth: int = 6, step: float = 0.1, row_share: float = 0.8, column_share: float = 0.8,
    parallel: int = 4, seed: int = config.SEED,
) -> OneVsRestModel:
    """One boosted binary model per class, on balanced row weights."""
    rows = _training_rows(train, features, label, classes, True)
    one = GBTClassifier(
        maxIter=rounds, maxDepth=depth, stepSize=step, subsamplingRate=row_share,
        featureSubsetStrategy=str(column_share), weightCol="weight", seed=seed,
    )
    return OneVsRest(classifier=one, parallelism=parallel, weightCol="weight").fit(rows)


def fit_network(
    train: DataFrame, features: Sequence[str], label: str = "label_int", classes: int = len(config.CLASSES),
    hidden: Sequence[int] = (128, 64, 32), epochs: int = 50, tol: float = 1e-4, block: int = 512, seed: int = config.SEED,
) -> MultilayerPerceptronClassificationModel:
    """Feed-forward net; unweighted, since this estimator takes no row weights."""
    rows = _training_rows(train, features, label, classes, False)
    return MultilayerPerceptronClassifier(
        layers=[len(features), *hidden, classes], maxIter=epochs, tol=tol, blockSize=block, seed=seed
    ).fit(rows)


def with_probabilities(df: DataFrame, model, features: Sequence[str], classes: Sequence[str] = config.CLASSES) -> DataFrame:
    """Add ``probs``, one entry per class in order.

    For one-vs-rest boosting each class's logistic output is taken and the row is
    normalised to 1. Classes the model never saw get 0.
    """
    rows = assemble(df, features, "_features")
    if isinstance(model, OneVsRestModel):
        outs = []
        for k, member in enumerate(model.models):
            m = member.copy()
            m.setFeaturesCol("_features").setRawPredictionCol(f"_raw{k}").setProbabilityCol(f"_p{k}").setPredictionCol(f"_y{k}")
            rows = m.transform(rows).drop(f"_raw{k}", f"_y{k}")
            outs.append(vector_to_array(F.col(f"_p{k}"))[1])
        rows = rows.withColumn("_each", F.array(*outs))
        total = F.aggregate("_each", F.lit(0.0), lambda a, x: a + x)
        probs = F.transform("_each", lambda x: F.when(total > 0, x / total).otherwise(1.0 / len(outs)))
        rows = rows.withColumn("probs", probs).drop("_each", *[f"_p{k}" for k in range(len(outs))])
        width = len(outs)
    else:
        m = model.copy()
        m.setFeaturesCol("_features").setRawPredictionCol("_raw").setProbabilityCol("_prob").setPredictionCol("_y")
        rows = m.transform(rows).withColumn("probs", vector_to_array("_prob")).drop("_raw", "_prob", "_y")
        width = m.numClasses
    if width < len(classes):
        rows = rows.withColumn("probs", F.concat("probs", F.array_repeat(F.lit(0.0), len(classes) - width)))
    return rows.drop("_features")


def score(df: DataFrame, model, features: Sequence[str], classes: Sequence[str] = config.CLASSES) -> DataFrame:
    return with_verdict(with_probabilities(df, model, features, classes), "probs", classes)


def importances(model) -> list[float]:
    """Feature importances; for one-vs-rest the mean over the class models."""
    models = model.models if isinstance(model, OneVsRestModel) else [model]
    rows = [m.featureImportances.toArray() for m in models]
    return [float(sum(col) / len(rows)) for col in zip(*rows)]


def rank_features(spark, features: Sequence[str], scores: Sequence[float]) -> DataFrame:
    """(pos, feature, importance, rank); one row per feature, ties in feature order."""
    order = sorted(range(len(features)), key=lambda i: (-scores[i], i))
    rows = [(i, features[i], float(scores[i]), r + 1) for r, i in enumerate(order)]
    return local_table(spark, rows, "pos int, feature string, importance double, rank int")


def top_features_of(features: Sequence[str], scores: Sequence[float], k: int) -> list[str]:
    order = sorted(range(len(features)), key=lambda i: (-scores[i], i))
    return [features[i] for i in order[:k]]


FITS: dict[str, Callable] = {"random_forest": fit_forest, "boosted": fit_boosted, "network": fit_network}

# The six swept configurations.
SWEEP: list[dict] = [
    {"name": "rf_baseline", "kind": "random_forest", "features": "full", "args": {"trees": 100, "depth": 20, "min_leaf": 2}},
    {"name": "xgb_baseline", "kind": "boosted", "features": "full", "args": {"rounds": 200, "depth": 6, "step": 0.1, "row_share": 0.8, "column_share": 0.8}},
    {"name": "xgb_deep", "kind": "boosted", "features": "full", "args": {"rounds": 400, "depth": 8, "step": 0.05, "row_share": 0.9, "column_share": 0.8}},
    {"name": "mlp_baseline", "kind": "network", "features": "full", "args": {"hidden": [128, 64, 32], "epochs": 50, "block": 512}},
    {"name": "xgb_top40", "kind": "boosted", "features": "top40", "args": {"rounds": 200, "depth": 6, "step": 0.1, "row_share": 0.8, "column_share": 0.8}},
    {"name": "xgb_top40_tuned", "kind": "boosted", "features": "top40", "args": {"rounds": 400, "depth": 7, "step": 0.06, "row_share": 0.9, "column_share": 0.9}},
]


def evaluate_model(test: DataFrame, model, features: Sequence[str], classes: dict[str, int], name: str, ord_: int) -> dict[str, DataFrame]:
    names = sorted(classes, key=classes.get)
    scored = score(test, model, features, names).select(
        F.lit(name).alias("model"), F.lit(ord_).cast("long").alias("ord"), F.col("label_class").alias("truth"), "prediction"
    )
    by = ("model", "ord")
    pairs = settle(pair_counts(scored, by=by), by)
    rates = per_class(pairs, classes, by)
    return {"confusion": confusion_matrix(pairs, classes, by), "per_class": rates, "summary": summary(rates, by)}


def feature_experiment(
    train: DataFrame, test: DataFrame, sets: dict[str, Sequence[str]], classes: dict[str, int],
    kind: str = "random_forest", **args,
) -> DataFrame:
    """Fit the same model on each feature set and compare on the same test rows."""
    parts = []
    for i, (name, features) in enumerate(sets.items()):
        model = FITS[kind](train, features, classes=len(classes), **args)
        parts.append(
            evaluate_model(test, model, features, classes, name, i)["summary"]
            .withColumn("feature_count", F.lit(len(features)))
        )
    return reduce(DataFrame.unionByName, parts).withColumnRenamed("model", "feature_set").orderBy(F.desc("macro_f1"), "ord")


def feature_sets(features: Sequence[str], scores: Sequence[float], unfiltered: Sequence[str] = (), ks=(20, 30, 40)) -> dict[str, list[str]]:
    """Top-k sets smaller than the filtered set, the filtered set, the unfiltered one."""
    sets = {f"Top-{k} Features": top_features_of(features, scores, k) for k in ks if k < len(features)}
    sets[f"{len(features)}-Feature Set (Filtered)"] = list(features)
    if unfiltered:
        sets[f"{len(unfiltered)}-Feature Set (Unfiltered)"] = list(unfiltered)
    return sets


def sweep(
    train: DataFrame, test: DataFrame, features: Sequence[str], classes: dict[str, int] = config.CLASS_IDS,
    configs: Sequence[dict] = SWEEP, ranking: Sequence[float] | None = None, incumbent: tuple[str, float, float] | None = None,
    record: SweepRecord | None = None,
) -> list[dict]:
    """Fit, evaluate and gate each configuration; each verdict sets the next incumbent.

    Every fit and evaluation is a distributed job. What reaches the driver is one
    metrics row per configuration. With a ``record`` every decision is written as it falls, the serving set of a
    promotion with it; a sweep that is started again goes on after the decisions recorded.
    """
    out = []
    done = record.decided() if record else set()
    if record:
        record.recover()
        incumbent = record.incumbent() or incumbent
    for i, cfg in enumerate(configs):
        if cfg["name"] in done:
            continue
        chosen = list(features)
        if cfg["features"].startswith("top"):
            if ranking is None:
                ranking = importances(fit_boosted(train, features, classes=len(classes), rounds=100))
            chosen = top_features_of(features, ranking, int(cfg["features"][3:]))
        started = time.perf_counter()
        model = FITS[cfg["kind"]](train, chosen, classes=len(classes), **cfg["args"])
        seconds = time.perf_counter() - started
        tables = evaluate_model(test, model, chosen, classes, cfg["name"], i)
        row = gate_metrics(tables["per_class"], tables["summary"], ("model", "ord"))
        row = row.select(*[F.round(x, 6).alias(x) if x in ("accuracy", "macro_f1", "mean_attack_fnr", "macro_attack_f1") else F.col(x) for x in row.columns])
        name, f1, fnr = incumbent or (None, None, None)
        old = local_table(row.sparkSession, [(name, f1, fnr)] if name else [], "model string, macro_f1 double, mean_attack_fnr double")
        decided = decide(against(row.withColumn("champion", F.lit(name).cast("string")), old)).first()
        out.append({"config": cfg, "model": model, "features": chosen, "decision": decided, "train_seconds": seconds})
        if record:
            record.add(decided.asDict(), model, chosen)
        if decided["promoted"]:
            incumbent = (cfg["name"], decided["macro_f1"], decided["mean_attack_fnr"])
    return out

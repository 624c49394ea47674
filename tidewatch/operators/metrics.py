"""Classification metrics from (truth, prediction) pairs.

The rows are counted once per (truth, prediction); everything after that works on
at most classes x classes rows per model.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import config
from ..functions.labels import class_dimension
from ..functions.numeric import ratio
from ..session import bounded, local_table

# Summary columns of a metrics document, in report order.
SUMMARY = [
    "accuracy", "macro_f1", "macro_precision", "macro_recall", "weighted_f1", "weighted_precision",
    "weighted_recall", "mean_fnr", "mean_attack_fnr", "macro_attack_f1", "macro_attack_recall",
    "mean_minority_f1", "mean_minority_fnr",
]


def pair_counts(scored: DataFrame, truth: str = "truth", pred: str = "prediction", by: Sequence[str] = ()) -> DataFrame:
    """Rows per (truth, prediction); rows without truth are left out."""
    return (
        scored.where(F.col(truth).isNotNull())
        .groupBy(*by, F.col(truth).alias("truth"), F.col(pred).alias("prediction"))
        .agg(F.count("*").alias("n"))
    )


def settle(pairs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The pair counts as constants: at most classes x classes rows for each of a few
    models, so that later tables do not score the rows again."""
    names = [*by, "truth", "prediction", "n"]
    rows = [tuple(r) for r in pairs.select(*names).collect()]
    return local_table(pairs.sparkSession, rows, ", ".join(f"{n} {pairs.schema[n].dataType.simpleString()}" for n in names))


def confusion_matrix(
    pairs: DataFrame, classes: dict[str, int] = config.CLASS_IDS, by: Sequence[str] = ()
) -> DataFrame:
    """Every class x class cell, zero where no row fell."""
    dim = class_dimension(pairs.sparkSession, classes)
    cells = dim.select(F.col("label_class").alias("truth"), F.col("class_id").alias("truth_id")).crossJoin(
        dim.select(F.col("label_class").alias("prediction"), F.col("class_id").alias("prediction_id"))
    )
    if by:
        cells = pairs.select(*by).distinct().crossJoin(bounded(cells, len(classes) ** 2))
    # Null-safe keys: no null test is pushed below the count, where it would score rows twice.
    keys = [*by, "truth", "prediction"]
    counted = pairs.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("n").alias("_n"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    return cells.join(counted, same, "left").select(*cells.columns, F.coalesce("_n", F.lit(0)).alias("n"))


def confusion_pivot(pairs: DataFrame, classes: dict[str, int] = config.CLASS_IDS, by: Sequence[str] = ()) -> DataFrame:
    """One row per true class, one column per predicted class."""
    cells = confusion_matrix(pairs, classes, by)
    names = sorted(classes, key=classes.get)
    return cells.groupBy(*by, "truth_id", "truth").agg(
        *[F.sum(F.when(F.col("prediction") == n, F.col("n")).otherwise(0)).alias(n) for n in names]
    )


def per_class(
    pairs: DataFrame, classes: dict[str, int] = config.CLASS_IDS, by: Sequence[str] = ()
) -> DataFrame:
    """Counts and rates per class; the rates of a class without test rows are NULL."""
    sides = pairs.select(
        *by,
        F.inline(
            F.array(
                F.struct(
                    F.col("truth").alias("label_class"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted"),
                    F.when(F.col("truth") == F.col("prediction"), F.col("n")).otherwise(0).alias("tp"),
                ),
                F.struct(
                    F.col("prediction").alias("label_class"), F.lit(0).cast("long").alias("support"),
                    F.col("n").alias("predicted"), F.lit(0).cast("long").alias("tp"),
                ),
            )
        ),
    )
    sums = sides.groupBy(*by, "label_class").agg(*[F.sum(x).alias(x) for x in ("support", "predicted", "tp")])
    dim = class_dimension(pairs.sparkSession, classes)
    total = pairs.groupBy(*by).agg(F.sum("n").alias("total"))
    frame = total.crossJoin(bounded(dim, len(classes)))
    counted = frame.join(sums, [*by, "label_class"], "left").na.fill(0, ["support", "predicted", "tp"])
    rated = counted.withColumns(
        {"fn": F.col("support") - F.col("tp"), "fp": F.col("predicted") - F.col("tp")}
    ).withColumns(
        {
            "tn": F.col("total") - F.col("tp") - F.col("fn") - F.col("fp"),
            "insufficient_test_support": F.col("support") == 0,
            "_p": ratio(F.col("tp"), F.col("predicted")),
            "_r": ratio(F.col("tp"), F.col("support")),
        }
    ).withColumn("_f", ratio(2 * F.col("_p") * F.col("_r"), F.col("_p") + F.col("_r")))
    known = F.col("support") > 0
    return rated.select(
        *by, "class_id", "label_class", "support",
        F.when(known, F.col("_p")).alias("precision"),
        F.when(known, F.col("_r")).alias("recall"),
        F.when(known, F.col("_f")).alias("f1"),
        F.when(known, F.try_divide("fn", "support")).alias("fnr"),
        "tp", "fn", "fp", "tn", "insufficient_test_support",
    )


def summary(classes: DataFrame, by: Sequence[str] = (), minority: int = config.MINORITY_SUPPORT) -> DataFrame:
    """Global and security metrics from the per-class table.

    Macro means run over the classes seen in truth or prediction, where a class
    that is only predicted counts as 0. The miss-rate means run over classes with
    support only.
    """
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    seen = (F.col("support") + F.col("fp")) > 0
    known = F.col("support") > 0
    attack = known & (F.col("label_class") != config.BENIGN)
    rare = attack & (F.col("support") < minority)
    mean = lambda when, x: zero(F.avg(F.when(when, x)))
    weighted = lambda m: ratio(F.sum(zero(F.col(m)) * F.col("support")), F.sum("support"))
    return classes.groupBy(*by).agg(
        F.sum("support").alias("test_samples"),
        ratio(F.sum("tp"), F.sum("support")).alias("accuracy"),
        *[mean(seen, zero(F.col(m))).alias(f"macro_{m}") for m in ("f1", "precision", "recall")],
        *[weighted(m).alias(f"weighted_{m}") for m in ("f1", "precision", "recall")],
        mean(known, F.col("fnr")).alias("mean_fnr"),
        mean(attack, F.col("fnr")).alias("mean_attack_fnr"),
        mean(attack, F.col("f1")).alias("macro_attack_f1"),
        mean(attack, F.col("recall")).alias("macro_attack_recall"),
        mean(rare, F.col("f1")).alias("mean_minority_f1"),
        mean(rare, F.col("fnr")).alias("mean_minority_fnr"),
    )


def evaluate(
    scored: DataFrame, truth: str = "truth", pred: str = "prediction",
    classes: dict[str, int] = config.CLASS_IDS, by: Sequence[str] = (),
) -> dict[str, DataFrame]:
    """Confusion cells, per-class table and summary of scored rows."""
    pairs = pair_counts(scored, truth, pred, by)
    rates = per_class(pairs, classes, by)
    return {"confusion": confusion_matrix(pairs, classes, by), "per_class": rates, "summary": summary(rates, by)}


def metrics_document(per_class_df: DataFrame, summary_df: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """One nested row per model: summary struct and class map, rounded as reports are."""
    rates = ("precision", "recall", "f1", "fnr")
    entry = F.struct(
        "label_class",
        F.struct(
            "class_id", "support", *[F.round(x, 6).alias(x) for x in rates], "tp", "fn", "fp", "tn", "insufficient_test_support"
        ).alias("stats"),
    )
    nested = per_class_df.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("per_class"))
    flat = summary_df.select(*by, "test_samples", F.struct(*[F.round(m, 6).alias(m) for m in SUMMARY]).alias("summary"))
    return flat.join(nested, list(by))


def flatten_metrics(per_class_df: DataFrame, summary_df: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """(model, metric, value) rows; classes without support are skipped."""
    long = lambda df, names, name: df.select(
        *by, F.inline(F.array(*[F.struct(name(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in names]))
    )
    cls = F.replace(F.col("label_class"), F.lit(" "), F.lit("_"))
    supported = per_class_df.where("support > 0")
    detail = long(
        supported, ["precision", "recall", "f1", "fnr", "support"],
        lambda m: F.concat(F.lit("per_class."), cls, F.lit(f".{m}")),
    )
    return long(summary_df, SUMMARY, F.lit).unionByName(detail)


def leaderboard(summaries: DataFrame) -> DataFrame:
    """Models by macro F1, then attack miss rate, then attack F1. One row per model."""
    everyone = Window.partitionBy(F.lit(0))
    order = [F.desc("macro_f1"), F.asc("mean_attack_fnr"), F.desc("macro_attack_f1"), F.asc("ord")]
    return summaries.withColumn("rank", F.row_number().over(everyone.orderBy(*order)))


def metric_rankings(summaries: DataFrame, latency: str | None = None) -> DataFrame:
    """Rank of every model on single metrics, ties in input order."""
    everyone = Window.partitionBy(F.lit(0))
    keys = {
        "by_macro_f1": F.desc("macro_f1"),
        "by_lowest_attack_fnr": F.asc("mean_attack_fnr"),
        "by_macro_attack_f1": F.desc("macro_attack_f1"),
    }
    if latency:
        keys["by_lowest_latency"] = F.asc(latency)
    return summaries.select(
        "model", "ord", *[F.row_number().over(everyone.orderBy(k, F.asc("ord"))).alias(n) for n, k in keys.items()]
    )


def recommend(summaries: DataFrame) -> DataFrame:
    """Top of the leaderboard; one row with a NULL champion when there are no models."""
    best = leaderboard(summaries).where("rank = 1").agg(F.first("model").alias("provisional_champion"), F.first("macro_f1").alias("macro_f1"))
    return best

"""Verdicts from class probabilities and the analyst's aggregates over them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config
from ..functions.labels import class_dimension
from ..functions.numeric import ratio
from ..functions.verdict import (
    argmax_class, bin_label, confidence_bin, direction_text, increases_threat, is_attack, probability_map, threat_level,
)
from ..session import bounded, local_table
from .prefix import row_at


def with_verdict(df: DataFrame, probs: str = "probs", classes: Sequence[str] = config.CLASSES) -> DataFrame:
    """Add prediction, confidence, attack flag and the class-probability map."""
    p = F.col(probs)
    scored = df.withColumns({"prediction": argmax_class(p, classes), "confidence": F.array_max(p)})
    return scored.withColumns(
        {"is_attack": is_attack(F.col("prediction")), "probabilities": probability_map(p, classes)}
    )


def class_breakdown(scored: DataFrame, classes: dict[str, int] = config.CLASS_IDS) -> DataFrame:
    """Predicted rows per class of the taxonomy, zero where there are none."""
    counts = scored.groupBy("prediction").agg(F.count("*").alias("n"))
    dim = class_dimension(scored.sparkSession, classes)
    # A null-safe key keeps the planner from pushing a null test, and with it a
    # second evaluation of the verdict, below the aggregate.
    joined = dim.join(counts, F.col("label_class").eqNullSafe(F.col("prediction")), "left")
    return joined.select("class_id", "label_class", F.coalesce("n", F.lit(0)).alias("n"))


def attack_totals(scored: DataFrame, high: float = config.THREAT_HIGH, medium: float = config.THREAT_MEDIUM) -> DataFrame:
    """Totals, attack rate and threat level of a scored table; one row."""
    totals = scored.agg(F.count("*").alias("total_connections"), F.count_if("is_attack").alias("total_attacks"))
    rate = ratio(F.col("total_attacks"), F.col("total_connections"))
    return totals.select(
        "total_connections", "total_attacks",
        (F.col("total_connections") - F.col("total_attacks")).alias("total_benign"),
        rate.alias("attack_rate"), threat_level(rate, high, medium).alias("threat_level"),
    )


def confidence_histogram(scored: DataFrame, bins: Sequence[tuple[float, float]] = config.CONFIDENCE_BINS) -> DataFrame:
    """Rows per confidence bin; empty bins stay."""
    counts = scored.groupBy(confidence_bin(F.col("confidence"), bins).alias("_bin")).agg(F.count("*").alias("n"))
    dim = local_table(scored.sparkSession, [(i, bin_label(*b)) for i, b in enumerate(bins)], "bin int, bucket string")
    return dim.join(counts, F.col("bin").eqNullSafe(F.col("_bin")), "left").select("bin", "bucket", F.coalesce("n", F.lit(0)).alias("count"))


def accuracy(scored: DataFrame, truth: str = "truth") -> DataFrame:
    """Accuracy over the rows with a resolved truth, and how many those are."""
    hit = (F.col(truth) == F.col("prediction")).cast("int")
    return scored.agg(F.avg(hit).alias("accuracy"), F.count(F.col(truth)).alias("scored"))


def dataset_profile(df: DataFrame, truth: str = "truth") -> DataFrame:
    """Rows, resolved class counts and attack rate over all rows; NULL rate if unlabelled."""
    per_class = df.groupBy(truth).agg(F.count("*").alias("n"))
    known = F.col(truth).isNotNull()
    hostile = F.sum(F.when(known & (F.col(truth) != config.BENIGN), F.col("n")).otherwise(0))
    labelled = F.coalesce(F.sum(F.when(known, F.col("n"))), F.lit(0))
    entries = F.array_sort(F.collect_list(F.when(known, F.struct(truth, "n"))))
    return per_class.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_flows"),
        (labelled > 0).alias("labelled"),
        F.map_from_entries(entries).alias("class_counts"),
        F.when(labelled > 0, F.try_divide(hostile, F.sum("n"))).alias("attack_rate"),
    )


def first_rows(df: DataFrame, order: str | Sequence[str], limit: int, parts: int | None = None) -> DataFrame:
    """The first ``limit`` rows by the columns ``order`` of any type, null first, in that order.

    A sorted limit would bring ``limit`` rows of every partition to one task. Here the key of the last row
    wanted is found over ordered ranges of the keys, and the table is filtered with it. ``order`` should be unique:
    rows that tie with the last one are all returned.
    """
    keys = [order] if isinstance(order, str) else list(order)
    if limit <= 0:
        return df.limit(0)
    cut = row_at(df, keys, limit, parts).agg(F.max(F.struct(*keys)).alias("_cut"))
    return df.crossJoin(F.broadcast(cut)).where(F.col("_cut").isNull() | (F.struct(*keys) <= F.col("_cut"))).drop("_cut").orderBy(*keys)


def page(df: DataFrame, order: str, number: int, size: int = 20) -> DataFrame:
    return df.orderBy(order).offset(number * size).limit(size)


def threats(df: DataFrame) -> DataFrame:
    return df.where("is_attack")


def top_suspicious(scored: DataFrame, order: str, limit: int = 10) -> DataFrame:
    """Most confident attacks of all rows, by 4-digit confidence, then row order."""
    return scored.where("is_attack").withColumn("confidence", F.round("confidence", 4)).orderBy(F.desc("confidence"), order).limit(limit)


def ranked_probabilities(scored: DataFrame, keep: Sequence[str], first: int = 4, floor: float = 0.001) -> DataFrame:
    """Classes of each row by probability: the first few, later ones only above a floor.

    Sorting happens inside the row, so nothing is shuffled.
    """
    entries = F.transform(
        F.map_entries("probabilities"), lambda e: F.struct((-e["value"]).alias("_d"), e["key"].alias("label_class"), e["value"].alias("p"))
    )
    ranked = scored.select(*keep, F.posexplode(F.array_sort(entries)).alias("_i", "_e"))
    return ranked.where((F.col("_i") < first) | (F.col("_e.p") >= floor)).select(
        *keep, (F.col("_i") + 1).alias("rank"), F.col("_e.label_class").alias("label_class"), F.col("_e.p").alias("probability")
    )


def top_features(contributions: Column, values: Column, features: Sequence[str], attack: Column, k: int = 3) -> Column:
    """The k largest contributions of a row by size, with value and direction; row-local."""
    zipped = F.zip_with(
        F.arrays_zip(contributions.alias("s"), values.alias("v")),
        F.array(*[F.struct(F.lit(i).alias("i"), F.lit(f).alias("f")) for i, f in enumerate(features)]),
        lambda x, f: F.struct((-F.abs(x["s"])).alias("_d"), f["i"].alias("_i"), f["f"].alias("feature"), x["v"].alias("value"), x["s"].alias("s")),
    )

    def entry(e: Column) -> Column:
        raises = increases_threat(e["s"], attack)
        return F.struct(
            e["feature"].alias("feature"), F.round(e["value"], 4).alias("value"), F.round(e["s"], 6).alias("shap_value"),
            raises.alias("increases_threat"), direction_text(raises).alias("direction"),
        )

    return F.transform(F.slice(F.array_sort(zipped), 1, k), entry)


def top_in_row(contributions: Column, features: Sequence[str], k: int) -> Column:
    """The k largest contributions of a row's array as (feature, contribution, rank), ties by name; row-local."""
    named = F.zip_with(contributions, F.array(*[F.lit(f) for f in features]), lambda s, f: F.struct((-F.abs(s)).alias("_d"), f.alias("feature"), s.alias("contribution")))
    return F.transform(F.slice(F.array_sort(named), 1, k), lambda e, i: F.struct(e["feature"].alias("feature"), e["contribution"].alias("contribution"), (i + 1).alias("rank")))


def top_contributions(long: DataFrame, row: str, k: int, by: Sequence[str] = ()) -> DataFrame:
    """Top k of a long (row, feature, contribution) table; k rows per group pass the filter early."""
    w = Window.partitionBy(row, *by).orderBy(F.desc(F.abs("contribution")), "feature")
    return long.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def explain_long(verdicts: DataFrame, contributions: DataFrame, values: DataFrame, row: str, k: int = 3) -> DataFrame:
    """Verdict joined with contributions and raw values on (row, feature), top k each."""
    top = top_contributions(contributions, row, k)
    raises = increases_threat(F.col("contribution"), F.col("is_attack"))
    return (
        top.join(values, [row, "feature"])
        .join(verdicts.select(row, "prediction", "is_attack"), row)
        .withColumn("increases_threat", raises)
    )


def global_attribution(long: DataFrame) -> DataFrame:
    """Mean absolute contribution per feature over rows and classes."""
    return long.groupBy("feature").agg(F.avg(F.abs("contribution")).alias("mean_abs"))


def top_global(means: DataFrame, limit: int = 20) -> DataFrame:
    best = means.orderBy(F.desc("mean_abs"), "feature").limit(limit)
    w = Window.partitionBy(F.lit(0)).orderBy(F.desc("mean_abs"), "feature")
    return best.withColumn("rank", F.row_number().over(w))


def flagged_rows(scored: DataFrame, row: str = "flow_id") -> DataFrame:
    """Attack rows as flat text for the analyst's file."""
    listed = F.array_join(
        F.transform("top_features", lambda f: F.concat(f["feature"], F.lit("="), f["value"].cast("string"))), "; "
    )
    return scored.where("is_attack").select(
        F.col(row).alias("flow_id"), F.col("prediction").alias("predicted_class"),
        F.round("confidence", 4).alias("confidence"), listed.alias("top_features"),
    )


def nonzero_classes(breakdown: DataFrame) -> DataFrame:
    return breakdown.where("n > 0")


def representatives(
    scored: DataFrame, key: str, truth: str = "truth", extra_benign: int = 1
) -> DataFrame:
    """Sample rows per true class: the most confident correct ones.

    BENIGN gives one more than the others. A class with fewer correct rows than
    wanted gives its most confident rows of any kind, flagged as not verified. Both
    rankings keep only a few rows per class, which Spark cuts before the shuffle.
    """
    wanted = F.when(F.col(truth) == config.BENIGN, 1 + extra_benign).otherwise(1)
    rows = scored.where(F.col(truth).isNotNull()).withColumn("correct", F.col(truth) == F.col("prediction"))
    enough = rows.groupBy(truth).agg((F.count_if("correct") >= F.max(wanted)).alias("verified"))
    w = Window.partitionBy(truth, "correct").orderBy(F.desc("confidence"), key)
    shortlist = rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= 1 + extra_benign)
    usable = shortlist.join(F.broadcast(enough), truth).where("correct OR NOT verified")
    final = Window.partitionBy(truth).orderBy(F.desc("confidence"), key)
    picked = usable.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= wanted)
    return picked.withColumn("correctly_classified", F.col("verified") & F.col("correct")).drop("_r", "verified")


def first_correct_per_group(
    scored: DataFrame, key: str, groups: Sequence[tuple[str, Sequence[str]]], truth: str = "truth"
) -> DataFrame:
    """One correctly classified row per class group, trying its classes in order."""
    pairs = [(g, i, n) for g, names in groups for i, n in enumerate(names)]
    dim = local_table(scored.sparkSession, pairs, f"sample_type string, class_rank int, {truth} string")
    hits = scored.where(F.col(truth) == F.col("prediction"))
    w = Window.partitionBy("sample_type").orderBy("class_rank", key)
    joined = hits.join(bounded(dim, sum(len(n) for _, n in groups)), truth)
    return joined.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def contract_violations(
    scored: DataFrame, parameters: DataFrame, features: Sequence[str],
    probs: str = "probs", classes: dict[str, int] = config.CLASS_IDS,
) -> DataFrame:
    """(check, violations) of the scoring contract; all zero when it holds."""
    total = F.aggregate(F.col(probs), F.lit(0.0), lambda a, x: a + x)
    bad_sum = scored.agg(F.count_if(~(F.abs(total - 1.0) < 1e-4) | total.isNull()).alias("violations"))
    wrong_width = scored.agg(F.count_if(F.size(probs) > len(classes)).alias("violations"))
    names = class_dimension(scored.sparkSession, classes)
    strange = (
        scored.groupBy(F.col("prediction").alias("label_class")).agg(F.count("*").alias("n"))
        .join(bounded(names, len(classes)), "label_class", "left_anti")
        .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("violations"))
    )
    expected = local_table(scored.sparkSession, list(enumerate(features)), "pos int, feature string")
    order = expected.exceptAll(parameters.select("pos", "feature")).unionByName(
        parameters.select("pos", "feature").exceptAll(expected)
    ).agg(F.count("*").alias("violations"))
    fills = parameters.agg(F.count_if(F.col("fill").isNull()).alias("violations"))
    codes = names.agg((F.count("*") - F.count_distinct("class_id")).alias("violations"))
    parts = {
        "probabilities_sum_to_one": bad_sum, "probability_width": wrong_width, "prediction_in_taxonomy": strange,
        "parameter_order": order, "fill_present": fills, "class_ids_unique": codes,
    }
    out = None
    for name, df in parts.items():
        one = df.select(F.lit(name).alias("check"), F.col("violations").cast("long").alias("violations"))
        out = one if out is None else out.unionByName(one)
    return out

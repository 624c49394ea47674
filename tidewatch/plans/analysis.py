"""Batch analysis of a flow export: one scored table, several small aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config
from ..functions.labels import resolve_truth
from ..functions.names import c, extract_labels, label_column, normalize_columns, unused_columns
from ..operators import attribution, scoring
from ..operators.preparing import coverage, display_values, prepare
from ..operators.scaling import Parameters
from ..session import stored
from .training import score


def score_export(
    export: DataFrame, model, params: Parameters, row: str = "flow_id", classes: dict[str, int] = config.CLASS_IDS
) -> DataFrame:
    """Verdict per flow: row id, scaled features, repairs, probabilities, truth if any."""
    names = sorted(classes, key=classes.get)
    table = normalize_columns(export, params.features, [row])
    keep = [row]
    if label_column(table) is not None:
        table = resolve_truth(extract_labels(table, "truth_raw"), "truth_raw")
        keep.append("truth")
    ready = prepare(table, params, normalized=True, allow_missing=True, keep=keep)
    return score(ready, model, params.features, names)


def analyze(
    export: DataFrame,
    model,
    params: Parameters,
    row: str = "flow_id",
    classes: dict[str, int] = config.CLASS_IDS,
    scored_rows: int | None = None,
    returned: int | None = None,
    explained: int | None = None,
    high: float = config.THREAT_HIGH,
    medium: float = config.THREAT_MEDIUM,
) -> dict[str, object]:
    """Everything the analyst sees, as DataFrames, plus the schema account.

    ``row`` orders the flows. All rows are scored; ``scored_rows`` sets the first-N
    limit where a caller wants the interactive behaviour. All rows are attributed and
    listed; ``returned`` and ``explained`` shorten the listing and the attribution to the
    first rows for a caller who asks, such as ``config.MAX_RETURNED_ROWS``.
    """
    first = lambda df, n: df if n is None else scoring.first_rows(df, row, n)
    if row not in export.columns:
        raise ValueError(f"the export needs an ordering column {row!r}")
    if export.isEmpty():
        raise ValueError("the export has no data rows")
    if scored_rows is not None:
        export = scoring.first_rows(export, row, scored_rows)
    normalized = normalize_columns(export, params.features, [row])
    # Several aggregates read the scored table and the contributions, so each is written once.
    scored = stored(score_export(export, model, params, row, classes), "scored")
    shown = first(scored, explained)
    k = F.array_position(F.array(*[F.lit(n) for n in sorted(classes, key=classes.get)]), F.col("prediction")) - 1
    parts = stored(attribution.tree_contributions(shown.withColumn("predicted_id", k), model, params.features, row, len(classes)), "contributions")
    raw = display_values(normalized, params, [row]).select(row, F.array(*[c(f) for f in params.features]).alias("_raw"))
    listing = (
        first(scored, returned).join(parts, row, "left").join(raw, row)
        .withColumn("top_features", scoring.top_features(F.col("contribution"), F.col("_raw"), params.features, F.col("is_attack")))
        .select(row, "prediction", F.round("confidence", 4).alias("confidence"), "is_attack", "probabilities", "top_features")
    )
    absent = coverage(normalized.columns, params.features)
    unused = unused_columns(normalized.columns, [*params.features, row])
    summary = scoring.attack_totals(scored, high, medium).withColumns(
        {
            "rows_returned": F.least("total_connections", F.lit(returned)),
            "rows_explained": F.least("total_connections", F.lit(explained)),
            "truncated": F.coalesce(F.col("total_connections") > F.lit(returned).cast("long"), F.lit(False)),
        }
    )
    return {
        "scored": scored,
        "summary": summary,
        "class_breakdown": scoring.class_breakdown(scored, classes),
        "confidence_histogram": scoring.confidence_histogram(scored),
        "top_suspicious": scoring.top_suspicious(scored, row),
        "global_attribution": scoring.top_global(attribution.global_importance(parts, params.features, len(classes))),
        "rows": listing,
        "truth_accuracy": scoring.accuracy(scored) if "truth" in scored.columns else None,
        "filled_cells": scored.agg(F.sum("n_filled").alias("n_filled_cells")),
        "coverage": absent,
        "columns_supplied": len(export.columns),
        "unused_columns": unused,
        "n_unused_columns": len(unused),
    }


def attribution_report(
    scored: DataFrame, model, features: Sequence[str], row: str, groups, classes: dict[str, int] = config.CLASS_IDS,
    rows: int | None = None, seed: int = config.SEED,
) -> dict[str, DataFrame]:
    """Global top features and one explained example per class group.

    All rows are explained; ``rows`` sets the size of a sample where a caller wants one.
    """
    from ..operators.sampling import uniform_sample

    names = sorted(classes, key=classes.get)
    sample = scored if rows is None else uniform_sample(scored, rows, [row], seed)
    k = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("prediction")) - 1
    parts = stored(attribution.tree_contributions(sample.withColumn("predicted_id", k), model, features, row, len(classes)), "contributions")
    values = sample.select(row, "truth", "prediction", "is_attack", F.array(*[c(f) for f in features]).alias("_x"))
    examples = scoring.first_correct_per_group(values, row, groups).join(parts, row).withColumn(
        "top_features", scoring.top_features(F.col("contribution"), F.col("_x"), features, F.col("is_attack"), 5)
    )
    return {
        "top_features": scoring.top_global(attribution.global_importance(parts, features, len(classes))),
        "examples": examples.select("sample_type", F.col("truth").alias("true_class"), F.col("prediction").alias("predicted_class"), "top_features"),
    }

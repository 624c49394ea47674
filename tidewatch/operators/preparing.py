"""Raw flow export to scaled model input, with an account of what was repaired."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config
from ..functions.names import by_exact_name, c, normalize_columns, numeric_columns
from ..functions.numeric import finite, is_finite, to_number
from .scaling import Parameters, scaled


def coverage(columns: Sequence[str], features: Sequence[str]) -> dict[str, object]:
    """How much of the feature contract the supplied columns meet."""
    have = set(columns)
    absent = [f for f in features if f not in have]
    matched = len(features) - len(absent)
    return {
        "features_expected": len(features),
        "features_matched": matched,
        "features_imputed": len(absent),
        "coverage": round(matched / len(features), 6) if features else 0.0,
        "imputed_columns": absent,
    }


def check_coverage(
    columns: Sequence[str], features: Sequence[str], allow_missing: bool, max_missing: float = config.MAX_MISSING_FRACTION
) -> list[str]:
    """Absent features, or an error when they are too many or not allowed. No job runs."""
    have = set(columns)
    absent = [f for f in features if f not in have]
    if absent and not allow_missing:
        raise ValueError(f"input lacks {len(absent)} required feature column(s): {absent}")
    if absent and len(absent) / len(features) > max_missing:
        raise ValueError(
            f"input lacks {len(absent)} of {len(features)} features, above the limit of {max_missing:.0%}: {absent}"
        )
    return absent


def prepare(
    df: DataFrame,
    params: Parameters,
    normalized: bool = False,
    allow_missing: bool = False,
    max_missing: float = config.MAX_MISSING_FRACTION,
    keep: Sequence[str] = (),
    flag_filled: bool = True,
) -> DataFrame:
    """Features coerced, filled and scaled in contract order, after the ``keep`` columns.

    ``n_filled`` counts the repaired cells of each row; absent columns are imputed
    with the training fill and are not part of that count.
    """
    df = df if normalized else normalize_columns(df)
    absent = set(check_coverage(df.columns, params.features, allow_missing, max_missing))
    numeric = set(numeric_columns(df))
    df, at = by_exact_name(df)

    def cell(f: str):
        if f in absent:
            return F.lit(None).cast("double")
        return finite(at[f] if f in numeric else to_number(at[f]))

    cells = {f: cell(f) for f in params.features}
    outs = [
        scaled(F.coalesce(cells[f], F.lit(params.fill[f])), params.center[f], params.scale[f]).alias(f)
        for f in params.features
    ]
    present = [f for f in params.features if f not in absent]
    filled = reduce(lambda a, b: a + b, [cells[f].isNull().cast("int") for f in present], F.lit(0))
    extra = [filled.alias("n_filled")] if flag_filled else []
    return df.select(*[at[k].alias(k) for k in keep], *extra, *outs)


def display_values(df: DataFrame, params: Parameters, keep: Sequence[str] = ()) -> DataFrame:
    """Raw feature values for reading: coerced, fill for missing, infinities kept."""
    numeric = set(numeric_columns(df))
    df, at = by_exact_name(df)

    def value(f: str):
        if f not in at:
            return F.lit(params.fill[f])
        raw = at[f].cast("double") if f in numeric else to_number(at[f])
        return F.coalesce(F.when(~F.isnan(raw), raw), F.lit(params.fill[f]))

    return df.select(*[at[k].alias(k) for k in keep], *[value(f).alias(f) for f in params.features])


def split_valid(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Strict mode: name the missing or non-finite features of each row.

    ``accepted`` is true where there are none.
    """
    bad = F.array_compact(F.array(*[F.when(~is_finite(c(f).cast("double")), F.lit(f)) for f in features]))
    return df.withColumn("rejected_features", bad).withColumn("accepted", F.size("rejected_features") == 0)


def with_context(df: DataFrame, defaults: dict[str, object] = config.CONTEXT_DEFAULTS) -> DataFrame:
    """Add the context columns that are absent; those present stay as they are."""
    return df.withColumns({n: F.lit(v) for n, v in defaults.items() if n not in df.columns})

"""Data-quality profiles: label counts, missing and infinite cells, constant columns."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import c
from ..functions.numeric import finite, inf_to_null, is_finite, is_inf

# Columns per aggregate. Every chunk reads only its own columns, so splitting a
# wide table costs no extra scan volume and keeps each aggregate code-generated.
CHUNK = 12


def label_counts(df: DataFrame, file: str = "source_file", label: str = "Label") -> DataFrame:
    """Rows per (file, label) and per label over all files (``source_file`` NULL there).

    The table is counted once; the rollup then works on the counts.
    """
    counts = df.groupBy(label, file).agg(F.count("*").alias("_n"))
    return (
        counts.rollup(label, file)
        .agg(F.sum("_n").alias("rows"), F.grouping(label).alias("_all"), F.grouping(file).alias("total"))
        .where("_all = 0")
        .select(file, label, F.col("total").cast("boolean").alias("all_files"), "rows")
    )


def distinct_labels(df: DataFrame, file: str = "source_file", label: str = "Label") -> DataFrame:
    return df.groupBy(file).agg(F.count_distinct(label).alias("labels"))


def cell_counts(df: DataFrame, floats: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Infinite and NaN cells over all float columns: two sums, however wide the table.

    A NULL cell of a nullable float column counts as NaN, as missing does on load.
    """

    def total(test: Callable[[Column], Column]) -> Column:
        hits = [F.coalesce(test(c(n)).cast("int"), F.lit(0)) for n in floats]
        return F.sum(reduce(lambda a, b: a + b, hits, F.lit(0)))

    return df.groupBy(*by).agg(
        total(is_inf).cast("long").alias("inf_count"),
        total(lambda x: x.isNull() | F.isnan(x)).cast("long").alias("nan_count"),
    )


def file_profile(
    df: DataFrame, floats: Sequence[str], n_columns: int, file: str = "source_file", label: str = "Label"
) -> DataFrame:
    """Rows, columns, Inf / NaN cells, missing and distinct labels for each file; one scan."""

    def cells(test: Callable[[Column], Column]) -> Column:
        hits = [F.coalesce(test(c(n)).cast("int"), F.lit(0)) for n in floats]
        return F.sum(reduce(lambda a, b: a + b, hits, F.lit(0))).cast("long")

    per_label = df.groupBy(file, label).agg(
        F.count("*").alias("rows"),
        cells(is_inf).alias("inf_count"),
        cells(lambda x: x.isNull() | F.isnan(x)).alias("nan_count"),
    )
    return per_label.groupBy(file).agg(
        F.sum("rows").alias("rows"),
        F.lit(n_columns).cast("long").alias("columns"),
        F.sum("inf_count").alias("inf_count"),
        F.sum("nan_count").alias("nan_count_numeric"),
        F.sum(F.when(F.col(label).isNull(), F.col("rows")).otherwise(0)).alias("nan_count_label"),
        F.count(label).alias("labels"),
    )


def wide_to_long(
    df: DataFrame,
    columns: Sequence[str],
    aggregates: dict[str, Callable[[Column], Column]],
    by: Sequence[str] = (),
    chunk: int = CHUNK,
) -> DataFrame:
    """Aggregate every column the same way; one result row per column (and group).

    The aggregates run in wide form, so no row is multiplied; only the one-row
    results are turned into ``(pos, feature, ...)`` form.
    """
    parts = []
    for start in range(0, len(columns), chunk):
        names = columns[start : start + chunk]
        exprs = [
            fn(c(n)).alias(f"_{i}_{out}") for i, n in enumerate(names) for out, fn in aggregates.items()
        ]
        rows = F.array(
            *[
                F.struct(
                    F.lit(start + i).alias("pos"),
                    F.lit(n).alias("feature"),
                    *[F.col(f"_{i}_{out}").alias(out) for out in aggregates],
                )
                for i, n in enumerate(names)
            ]
        )
        parts.append(df.groupBy(*by).agg(*exprs).select(*by, F.inline(rows)))
    return reduce(DataFrame.unionByName, parts)


def inf_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Positive and negative infinities per column."""
    return wide_to_long(
        df,
        columns,
        {
            "pos_inf": lambda x: F.count_if(x.cast("double") == F.lit(float("inf"))),
            "neg_inf": lambda x: F.count_if(x.cast("double") == F.lit(float("-inf"))),
        },
    )


def column_profile(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    return wide_to_long(
        df,
        columns,
        {
            "present": lambda x: F.count(finite(x)),
            "missing": lambda x: F.count_if(~is_finite(x.cast("double"))),
            "infinite": lambda x: F.count_if(is_inf(x.cast("double"))),
            "low": lambda x: F.min(finite(x)),
            "high": lambda x: F.max(finite(x)),
        },
        by,
    )


def constant_columns(
    df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), inf_breaks: bool = True
) -> DataFrame:
    """Columns with one value in at least two present cells.

    With ``inf_breaks`` a column that holds an infinity is not constant, as at
    load time; without, infinities count as missing, as after cleaning.
    """
    constant = (F.col("low") == F.col("high")) & (F.col("present") >= 2)
    if inf_breaks:
        constant = constant & (F.col("infinite") == 0)
    return column_profile(df, columns, by).where(constant).select(*by, "pos", "feature")


def class_distribution(df: DataFrame, cls: str = "label_class") -> DataFrame:
    """Rows and percentage per class. The window runs over one row per class."""
    counts = df.groupBy(cls).agg(F.count("*").alias("rows"))
    total = counts.agg(F.sum("rows").alias("_total"))
    return (
        counts.crossJoin(F.broadcast(total))
        .select(cls, "rows", (F.col("rows") * 100 / F.col("_total")).alias("percent"))
        .orderBy(F.desc("rows"), cls)
    )


def missing_cells(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Missing cells per column, missing meaning NULL, NaN or infinite."""
    return wide_to_long(df, columns, {"missing": lambda x: F.count_if(~is_finite(x.cast("double")))}, by)


def null_cell_total(df: DataFrame, columns: Sequence[str]) -> Column:
    return F.sum(reduce(lambda a, b: a + b, [c(n).isNull().cast("int") for n in columns], F.lit(0))).cast("long")


def check_no_missing(df: DataFrame, columns: Sequence[str], split: str = "split") -> None:
    """Split integrity: raise when any feature cell of any split is still missing."""
    left = {r[split]: r["missing"] for r in df.groupBy(split).agg(null_cell_total(df, columns).alias("missing")).collect()}
    if any(left.values()):
        raise RuntimeError(f"missing cells remain after the fill: {left}")


def class_support(df: DataFrame, cls_value: str, cls: str = "label_class", split: str = "split") -> DataFrame:
    """Rows of one class in each split."""
    return df.groupBy(split).agg(F.count_if(F.col(cls) == cls_value).alias("support"))


def replace_inf(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Infinities and NaN to NULL in the float columns."""
    targets = set(columns)
    return df.select(*[(inf_to_null(c(n)).alias(n) if n in targets else c(n)) for n in df.columns])

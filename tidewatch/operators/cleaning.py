"""Label mapping, Inf removal, deduplication, constant columns: the cleaning job."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config
from ..functions.labels import check_labels, map_labels_strict
from ..functions.names import c, floating_columns, numeric_columns
from ..functions.numeric import is_inf
from ..session import shared_dir
from .quality import constant_columns, replace_inf


def deduplicate(
    df: DataFrame, file: str = "source_file", manifest: Sequence[str] = config.MANIFEST
) -> DataFrame:
    """Exact-row deduplication that ignores the file and keeps the first one.

    Every column but the file is a grouping key. The kept file is the smallest
    manifest position, an int, so the aggregate stays a hash aggregate and copies
    of one row are combined on the map side.
    """
    if file not in df.columns:
        return df.dropDuplicates()
    keys = [n for n in df.columns if n != file]
    names = F.array(*[F.lit(n) for n in manifest])
    found = F.array_position(names, c(file)).cast("int")
    fail = F.raise_error(F.concat(F.lit("file outside the manifest: "), F.coalesce(c(file), F.lit("<null>"))))
    position = F.when(found > 0, found).otherwise(fail.cast("int"))
    first = df.groupBy(*[c(n) for n in keys]).agg(F.min(position).alias("_at"))
    return first.select(*[c(n) for n in keys], F.element_at(names, F.col("_at")).alias(file))


def cleaning_counts(df: DataFrame, file: str = "source_file") -> DataFrame:
    """Rows in and out, duplicates, infinite cells and missing cells, in one grouping.

    Grouping by the cleaned row gives the row count before (sum of copies) and
    after (groups) at once, so the table is shuffled a single time.
    """
    floats = floating_columns(df)
    inf_cells = reduce(lambda a, b: a + b, [F.coalesce(is_inf(c(n)).cast("int"), F.lit(0)) for n in floats], F.lit(0))
    cleaned = replace_inf(df.withColumn("_inf", inf_cells), floats)
    keys = [n for n in df.columns if n != file]
    nulls = reduce(lambda a, b: a + b, [c(n).isNull().cast("int") for n in numeric_columns(df)], F.lit(0))
    copies = cleaned.groupBy(*[c(n) for n in keys]).agg(F.count("*").alias("_n"), F.sum("_inf").alias("_inf"))
    return copies.agg(
        F.sum("_n").alias("input_rows"),
        F.sum("_inf").alias("inf_replaced"),
        F.sum(F.col("_n") * nulls).alias("missing_after"),
        F.count("*").alias("output_rows"),
        (F.sum("_n") - F.count("*")).alias("duplicates_dropped"),
    )


def drop_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    gone = set(names)
    return df.select(*[c(n) for n in df.columns if n not in gone])


def clean(
    df: DataFrame,
    label: str = "Label",
    label_map: dict[str, str] = config.LABEL_MAP,
    manifest: Sequence[str] = config.MANIFEST,
    drop_duplicates: bool = True,
    drop_constant: bool = True,
    fail_early: bool = True,
) -> tuple[DataFrame, list[str]]:
    """Clean a labelled flow table; returns it and the constant columns found.

    Order: map labels (unknown ones fail), Inf to missing, deduplicate, constant
    columns. ``label_raw`` stays and is part of the duplicate key.
    """
    if label not in df.columns:
        raise KeyError(f"no column {label!r}")
    if fail_early:
        check_labels(df, label, label_map)
    mapped = map_labels_strict(df, label, label_map).withColumnRenamed(label, "label_raw")
    rows = replace_inf(mapped, floating_columns(mapped))
    if drop_duplicates:
        # Read twice below, so the shuffled result is stored rather than made again.
        stored = shared_dir(df.sparkSession, "deduplicated")
        deduplicate(rows, manifest=manifest).write.parquet(stored)
        rows = df.sparkSession.read.parquet(stored)
    found = constant_columns(rows, numeric_columns(rows), inf_breaks=False).orderBy("pos")
    constant = [r["feature"] for r in found.collect()]
    return (drop_columns(rows, constant) if drop_constant else rows), constant

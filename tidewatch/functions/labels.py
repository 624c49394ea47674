"""Label text, class dimension and ground-truth resolution."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config
from ..session import bounded, local_table

# Fixed value: the character that stands for bytes a decoder could not read.
UNREADABLE = "�"

_EDGE_BLANKS = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"


def normalize_label(col: Column) -> Column:
    """Strip, then the unreadable character to `` - ``, then runs of blanks to one."""
    stripped = F.regexp_replace(col, _EDGE_BLANKS, "")
    dashed = F.replace(stripped, F.lit(UNREADABLE), F.lit(" - "))
    return F.regexp_replace(dashed, " {2,}", " ")


def display_label(col: Column) -> Column:
    """Like :func:`normalize_label`, but every run of white space becomes one blank."""
    dashed = F.replace(col, F.lit(UNREADABLE), F.lit(" - "))
    return F.trim(F.regexp_replace(dashed, r"(?U)[\s\x1c-\x1f]+", " "))


def safe_display(col: Column) -> Column:
    return F.replace(col, F.lit(UNREADABLE), F.lit("<UFFFD>"))


def normalize_label_text(text: str) -> str:
    """The driver-side form of :func:`normalize_label`, for map keys."""
    if not isinstance(text, str):
        raise TypeError(f"label must be text, got {type(text).__name__}")
    return re.sub(" {2,}", " ", text.strip().replace(UNREADABLE, " - "))


def label_dimension(spark: SparkSession, label_map: dict[str, str] = config.LABEL_MAP) -> DataFrame:
    """(norm, label_class); two classes for one key is an error."""
    dim: dict[str, str] = {}
    for raw, cls in label_map.items():
        if dim.setdefault(normalize_label_text(raw), cls) != cls:
            raise ValueError(f"label map collision on {normalize_label_text(raw)!r}")
    return local_table(spark, list(dim.items()), "norm string, label_class string")


def label_collisions(pairs: DataFrame, raw: str = "raw", cls: str = "label_class") -> DataFrame:
    """Keys that lead to more than one class in a mapping held as a table."""
    return (
        pairs.groupBy(normalize_label(F.col(raw)).alias("norm"))
        .agg(F.count_distinct(F.col(cls)).alias("classes"))
        .where("classes > 1")
    )


def class_dimension(spark: SparkSession, classes: dict[str, int] = config.CLASS_IDS) -> DataFrame:
    return local_table(spark, sorted(classes.items(), key=lambda kv: kv[1]), "label_class string, class_id int")


def map_labels(
    df: DataFrame, label: str = "Label", label_map: dict[str, str] = config.LABEL_MAP
) -> DataFrame:
    """Add ``label_class``; NULL where the label is unknown or missing."""
    dim = label_dimension(df.sparkSession, label_map)
    return (
        df.withColumn("norm", normalize_label(F.col(label)))
        .join(bounded(dim, len(label_map)), "norm", "left")
        .drop("norm")
    )


def unknown_labels(
    df: DataFrame, label: str = "Label", label_map: dict[str, str] = config.LABEL_MAP
) -> DataFrame:
    """Distinct normalised labels that no map entry covers (NULL included)."""
    seen = df.select(normalize_label(F.col(label)).alias("norm")).distinct()
    dim = label_dimension(df.sparkSession, label_map)
    return seen.join(bounded(dim, len(label_map)), "norm", "left_anti")


def map_labels_strict(
    df: DataFrame, label: str = "Label", label_map: dict[str, str] = config.LABEL_MAP
) -> DataFrame:
    """As :func:`map_labels`; an unknown or missing label fails the job when it runs."""
    mapped = map_labels(df, label, label_map)
    fail = F.raise_error(F.concat(F.lit("unknown label: "), F.coalesce(F.col(label), F.lit("<null>"))))
    return mapped.withColumn("label_class", F.coalesce("label_class", fail.cast("string")))


def check_labels(df: DataFrame, label: str = "Label", label_map: dict[str, str] = config.LABEL_MAP) -> None:
    """One aggregate up front: raise with every unknown label instead of the first."""
    unknown = [r["norm"] for r in unknown_labels(df, label, label_map).toLocalIterator()]
    if unknown:
        raise ValueError(f"unknown labels: {sorted(map(repr, unknown))}")


def encode_labels(
    df: DataFrame, cls: str = "label_class", classes: dict[str, int] = config.CLASS_IDS, out: str = "label_int"
) -> DataFrame:
    """Class name to integer; an unknown class fails the job."""
    dim = class_dimension(df.sparkSession, classes).select(F.col("label_class").alias(cls), F.col("class_id").alias(out))
    joined = df.join(bounded(dim, len(classes)), cls, "left")
    fail = F.raise_error(F.concat(F.lit("unknown class: "), F.coalesce(F.col(cls), F.lit("<null>"))))
    return joined.withColumn(out, F.coalesce(F.col(out), fail.cast("int")))


def decode_labels(
    df: DataFrame, code: str = "label_int", classes: dict[str, int] = config.CLASS_IDS, out: str = "label_class"
) -> DataFrame:
    dim = class_dimension(df.sparkSession, classes).select(F.col("class_id").alias(code), F.col("label_class").alias(out))
    return df.join(bounded(dim, len(classes)), code, "left")


def unknown_classes(df: DataFrame, cls: str = "label_class", classes: dict[str, int] = config.CLASS_IDS) -> DataFrame:
    known = class_dimension(df.sparkSession, classes).select(F.col("label_class").alias(cls))
    return df.select(cls).distinct().subtract(known)


def resolve_truth(
    df: DataFrame,
    truth: str,
    out: str = "truth",
    label_map: dict[str, str] = config.LABEL_MAP,
) -> DataFrame:
    """Case-blind truth resolution: raw labels and class names; NULL where neither fits."""
    lookup = {cls.lower(): cls for cls in label_map.values()}
    lookup |= {normalize_label_text(raw).lower(): cls for raw, cls in label_map.items()}
    dim = local_table(df.sparkSession, list(lookup.items()), f"_norm string, {out} string")
    return (
        df.withColumn("_norm", F.lower(normalize_label(F.col(truth).cast("string"))))
        .join(bounded(dim, len(lookup)), "_norm", "left")
        .drop("_norm")
    )

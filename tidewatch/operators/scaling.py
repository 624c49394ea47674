"""Fitted fills, correlation filter, scalers and the parameter table they form."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config
from ..functions.names import c
from ..functions.numeric import finite
from ..session import bounded, local_table
from .quality import wide_to_long
from .quantiles import quantiles

#: Rows from which the shift of a Gram matrix is taken.
SHIFT_ROWS = 1000
#: A variance below this share of the mean square is rounding: the column is constant.
FLAT = 1e-11

PARAMETER_SCHEMA = "pos int, feature string, fill double, center double, scale double"


@dataclass(frozen=True)
class Parameters:
    """One row per feature, in contract order: fill, centre and scale."""

    features: list[str]
    fill: dict[str, float]
    center: dict[str, float] = field(default_factory=dict)
    scale: dict[str, float] = field(default_factory=dict)

    def to_df(self, spark: SparkSession) -> DataFrame:
        rows = [
            (i, f, self.fill.get(f), self.center.get(f, 0.0), self.scale.get(f, 1.0)) for i, f in enumerate(self.features)
        ]
        return local_table(spark, rows, PARAMETER_SCHEMA)

    @staticmethod
    def from_df(df: DataFrame) -> "Parameters":
        """Read back a parameter table: one row per feature, so it is small."""
        rows = df.orderBy("pos").collect()
        names = [r["feature"] for r in rows]
        if [r["pos"] for r in rows] != list(range(len(rows))) or len(set(names)) != len(names):
            raise ValueError("parameter table needs positions 0..n-1 and distinct features")
        broken = [r["feature"] for r in rows if None in (r["fill"], r["center"], r["scale"])]
        if broken:
            raise ValueError(f"parameters missing for: {broken}")
        pick = lambda key: {r["feature"]: r[key] for r in rows}
        return Parameters(names, pick("fill"), pick("center"), pick("scale"))

    def slice(self, features: Sequence[str]) -> "Parameters":
        """The same parameters for a subset of the features, in the subset's order."""
        absent = [f for f in features if f not in self.center or f not in self.scale]
        if absent:
            raise ValueError(f"features without scaler parameters: {absent}")
        unfilled = [f for f in features if f not in self.fill]
        if unfilled:
            raise ValueError(f"features without fill value: {unfilled}")
        pick = lambda d: {f: d[f] for f in features}
        return Parameters(list(features), pick(self.fill), pick(self.center), pick(self.scale))

    def check_order(self, features: Sequence[str]) -> None:
        if list(features) != self.features:
            raise ValueError("feature order of the parameters differs from the model's")


def fit_fills(df: DataFrame, columns: Sequence[str], strategy: str = "median", **limits) -> dict[str, float]:
    """Fill value per column over present values: median, mean or zero."""
    if strategy == "median":
        return {n: v[0] for n, v in quantiles(df, columns, [0.5], **limits).items()}
    if strategy == "mean":
        rows = wide_to_long(df, columns, {"mean": lambda x: F.avg(finite(x))}).collect()
        return {r["feature"]: r["mean"] for r in rows}
    if strategy == "zero":
        return {n: 0.0 for n in columns}
    raise ValueError(f"unknown fill strategy {strategy!r}: use median, mean or zero")


def apply_fills(df: DataFrame, fills: dict[str, float]) -> DataFrame:
    """Replace missing cells of the fitted columns; others stay."""
    return df.select(
        *[
            F.coalesce(finite(c(n)), F.lit(fills[n])).alias(n) if fills.get(n) is not None else c(n)
            for n in df.columns
        ]
    )


def fill_report(df: DataFrame, fills: dict[str, float]) -> DataFrame:
    """Cells filled per column, with the value used; only columns that had any."""
    names = [n for n in fills if n in df.columns]
    counts = wide_to_long(df, names, {"n_filled": lambda x: F.count_if(finite(x).isNull())})
    values = local_table(df.sparkSession, [(n, fills[n]) for n in names], "feature string, fill_value double")
    return counts.where("n_filled > 0").join(values, "feature")


def correlated_columns(df: DataFrame, columns: Sequence[str], threshold: float = config.CORRELATION_THRESHOLD) -> list[str]:
    """Columns whose |r| with an earlier column is above the threshold; an undefined r drops none. One scan."""
    r = np.abs(pearson_matrix(masked_gram(df, columns)[0]))
    return [name for j, name in enumerate(columns) if any(r[i, j] > threshold for i in range(j))]


def masked_gram(df: DataFrame, columns: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Cross products of [mask, value, value squared] of all columns, three by three blocks, and the shift of the values.

    One scan: a task multiplies its batches and gives one matrix, row by row; rows of equal place are
    added on as many tasks as there are rows. Values are shifted to about 0 first, which
    keeps the products exact enough; the shift comes from a few rows and changes no correlation.
    """
    names = [f"x{i}" for i in range(len(columns))]
    values = df.select(*[finite(c(n)).alias(x) for x, n in zip(names, columns)])
    few = values.limit(SHIFT_ROWS).agg(*[F.avg(x).alias(x) for x in names]).first()
    late = [x for x in names if few[x] is None]  # a column whose first rows are empty
    some = values.agg(*[F.first(x, True).alias(x) for x in late]).first().asDict() if late else {}
    shift = np.array([few[x] if few[x] is not None else some[x] or 0.0 for x in names])
    width = 3 * len(names)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            x = np.stack([np.asarray(col.to_numpy(zero_copy_only=False), float) for col in batch.columns], 1) - shift
            mask = ~np.isnan(x)
            x[~mask] = 0.0
            z = np.concatenate([mask, x, x * x], 1)
            total += z.T @ z
        if total.any():
            yield pa.record_batch([pa.array(range(width), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "v"])

    rows = values.mapInArrow(products, "i int, v array<double>").groupBy("i").agg(Summarizer.sum(array_to_vector("v")).alias("v")).collect()
    gram = np.zeros((width, width))
    for r in rows:
        gram[r["i"]] = r["v"].toArray()
    return gram, shift


def pearson_matrix(gram: np.ndarray) -> np.ndarray:
    """Pairwise-complete correlations from a masked Gram matrix; NaN where either side is constant or has under two rows."""
    d = len(gram) // 3
    n, sx, sxx, sxy = gram[:d, :d], gram[d : 2 * d, :d], gram[2 * d :, :d], gram[d : 2 * d, d : 2 * d]
    sy, syy = sx.T, sxx.T  # sums over rows where both are present
    with np.errstate(invalid="ignore", divide="ignore"):
        vx, vy = n * sxx - sx * sx, n * syy - sy * sy
        flat = (vx <= FLAT * n * sxx) | (vy <= FLAT * n * syy)
        r = (n * sxy - sx * sy) / np.sqrt(vx * vy)
    return np.where(flat | (n < 2), np.nan, np.clip(r, -1.0, 1.0))


def correlation_pairs(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(i, j, r) for i < j over rows where both are present, from one scan; NULL r where undefined."""
    r = pearson_matrix(masked_gram(df, columns)[0])
    rows = [(i, j, columns[i], columns[j], None if np.isnan(r[i, j]) else float(r[i, j])) for i, j in combinations(range(len(columns)), 2)]
    return local_table(df.sparkSession, rows, "i int, j int, left string, right string, r double")


def fit_scaler(df: DataFrame, columns: Sequence[str], kind: str = "robust", **limits) -> tuple[dict[str, float], dict[str, float]]:
    """(centre, scale) per column; a zero scale becomes 1."""
    one = lambda s: 1.0 if not s else s
    if kind == "robust":
        found = quantiles(df, columns, [0.25, 0.5, 0.75], **limits)
        return {n: v[1] for n, v in found.items()}, {n: one(v[2] - v[0]) for n, v in found.items()}
    if kind == "standard":
        shape = {"a": lambda x: F.avg(finite(x)), "b": lambda x: F.stddev_pop(finite(x)), "lo": lambda x: F.min(finite(x)), "hi": lambda x: F.max(finite(x))}
        rows = wide_to_long(df, columns, shape).collect()
        # A constant column may show a rounding-size deviation; it counts as zero.
        return {r["feature"]: r["a"] for r in rows}, {r["feature"]: 1.0 if r["lo"] == r["hi"] else one(r["b"]) for r in rows}
    if kind == "minmax":
        rows = wide_to_long(df, columns, {"lo": lambda x: F.min(finite(x)), "hi": lambda x: F.max(finite(x))}).collect()
        return {r["feature"]: r["lo"] for r in rows}, {r["feature"]: one(r["hi"] - r["lo"]) for r in rows}
    raise ValueError(f"unknown scaler {kind!r}: use robust, standard or minmax")


def scaled(col, center: float, scale: float):
    return (col - F.lit(center)) / F.lit(scale if scale else 1.0)


def apply_scaler(df: DataFrame, params: Parameters) -> DataFrame:
    """Scale the fitted features in place; one projection."""
    known = set(params.features)
    return df.select(
        *[
            scaled(c(n), params.center[n], params.scale[n]).alias(n) if n in known else c(n)
            for n in df.columns
        ]
    )


def apply_long(long: DataFrame, table: DataFrame, value: str = "value") -> DataFrame:
    """Fill and scale rows in (feature, value) form by joining the parameter table."""
    x = F.coalesce(finite(F.col(value)), F.col("fill"))
    scale = F.when(F.col("scale") == 0, 1.0).otherwise(F.col("scale"))
    return (
        long.join(F.broadcast(table), "feature")
        .withColumn("scaled", (x - F.col("center")) / scale)
        .drop("pos", "fill", "center", "scale")
    )


def class_weights(df: DataFrame, cls: str) -> DataFrame:
    """Balanced weight n / (k * n_c) for the classes present."""
    counts = df.groupBy(cls).agg(F.count("*").alias("rows"))
    total = counts.agg(F.sum("rows").alias("_n"), F.count("*").alias("_k"))
    return counts.crossJoin(F.broadcast(total)).select(
        cls, "rows", (F.col("_n") / (F.col("_k") * F.col("rows"))).alias("weight")
    )


def with_sample_weight(df: DataFrame, cls: str, classes: int) -> DataFrame:
    """Add the row weight; ``classes`` bounds the number of classes."""
    return df.join(bounded(class_weights(df, cls).select(cls, "weight"), classes), cls)

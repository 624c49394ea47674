"""Per-feature distribution drift between a reference and a current table.

Each side is read once and collapsed to (feature, value, count) with map-side
combining, so a value that holds a third of all rows is one row afterwards. A reference is
kept in that form and merged with every table it is compared with. The
distribution functions are running sums over ordered ranges of the values: a feature is
spread over many tasks instead of one, however its values are spread.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import config
from ..functions.names import c, shared_columns
from ..functions.numeric import finite
from ..session import bounded, local_table, stored
from .prefix import ordered_parts, prefix_sums

# The exact two-sample law holds up to EXACT_LIMIT rows a side, the series of the one-sample law from SERIES_FROM on.
EXACT_LIMIT = 10_000
SERIES_FROM = 2_000


@dataclass(frozen=True)
class ValueHistogram:
    """A table's finite values by feature: ``counts`` is (pos, value, n), ``features`` names the positions."""

    counts: DataFrame
    features: list[str]

    def write(self, path: str) -> None:
        """Keep the histogram; ``read`` gives it back in any session."""
        spark = self.counts.sparkSession
        self.counts.write.mode("overwrite").parquet(f"{path}/counts")
        local_table(spark, list(enumerate(self.features)), "pos int, feature string").coalesce(1).write.mode("overwrite").parquet(f"{path}/features")

    @staticmethod
    def read(spark: SparkSession, path: str) -> "ValueHistogram":
        names = spark.read.parquet(f"{path}/features").orderBy("pos").collect()
        return ValueHistogram(spark.read.parquet(f"{path}/counts"), [r["feature"] for r in names])

    def pick(self, features: Sequence[str]) -> "ValueHistogram":
        """The same histogram for some of the features, in their order."""
        if list(features) == self.features:
            return self
        places = {f: i for i, f in enumerate(features)}
        pairs = [(i, places[f]) for i, f in enumerate(self.features) if f in places]
        kept = self.counts.join(F.broadcast(local_table(self.counts.sparkSession, pairs, "pos int, _to int")), "pos")
        return ValueHistogram(kept.select(F.col("_to").alias("pos"), "value", "n"), list(features))

    def sizes(self) -> list[tuple[int, float | None]]:
        """Rows and spread of every feature, from the collapsed values."""
        first = self.counts.groupBy("pos").agg(F.sum("n").alias("rows"), (F.sum(F.col("n") * F.col("value")) / F.sum("n")).alias("mean"), F.min("value").alias("lo"), F.max("value").alias("hi"))
        rows = {r["pos"]: r for r in first.collect()}
        means = local_table(self.counts.sparkSession, [(i, r["mean"]) for i, r in rows.items()], "pos int, mean double")
        around = self.counts.join(F.broadcast(means), "pos").groupBy("pos").agg(F.sum(F.col("n") * (F.col("value") - F.col("mean")) ** 2).alias("s"))
        squares = {r["pos"]: r["s"] for r in around.collect()}
        spread = lambda r: 0.0 if r["lo"] == r["hi"] else math.sqrt(squares[r["pos"]] / r["rows"])
        return [(rows[i]["rows"], spread(rows[i])) if i in rows else (0, None) for i in range(len(self.features))]


def value_histogram(df: DataFrame, features: Sequence[str]) -> ValueHistogram:
    """Distinct finite values of each feature with their counts; one scan, stored."""
    pairs = F.array(*[F.struct(F.lit(i).alias("pos"), finite(c(f)).alias("value")) for i, f in enumerate(features)])
    counts = df.select(F.inline(pairs)).where("value IS NOT NULL").groupBy("pos", "value").agg(F.count("*").alias("n"))
    return ValueHistogram(stored(counts, "histogram"), list(features))


def _histogram(side: DataFrame | ValueHistogram, features: Sequence[str]) -> ValueHistogram:
    return side.pick(features) if isinstance(side, ValueHistogram) else value_histogram(side, features)


def two_sample_ecdf(reference: DataFrame | ValueHistogram, current: DataFrame | ValueHistogram, features: Sequence[str], parts: int | None = None) -> DataFrame:
    """Cumulative counts of both sides at each distinct value, and the next value."""
    zero = F.lit(0).cast("long")
    ref = _histogram(reference, features).counts.select("pos", "value", F.col("n").alias("n_ref"), zero.alias("n_cur"))
    cur = _histogram(current, features).counts.select("pos", "value", zero.alias("n_ref"), F.col("n").alias("n_cur"))
    values = ref.union(cur).groupBy("pos", "value").agg(F.sum("n_ref").alias("n_ref"), F.sum("n_cur").alias("n_cur"))
    placed = ordered_parts(values, ["pos", "value"], parts)
    return prefix_sums(placed, ["pos"], "_part", ["value"], {"cum_ref": "n_ref", "cum_cur": "n_cur"}, lead=("next_value", "value")).drop("_part")


def feature_distances(reference: DataFrame | ValueHistogram, current: DataFrame | ValueHistogram, features: Sequence[str], parts: int | None = None) -> DataFrame:
    """Sample sizes, KS statistic, Wasserstein distance and reference spread per feature.

    The sizes and spreads are one row per feature and are fitted first.
    """
    ref, cur = _histogram(reference, features), _histogram(current, features)
    rows = [(i, f, n, spread, m) for i, (f, (n, spread), (m, _)) in enumerate(zip(features, ref.sizes(), cur.sizes()))]
    sizes = local_table(ref.counts.sparkSession, rows, "pos int, feature string, n_ref bigint, spread double, n_cur bigint")
    curve = two_sample_ecdf(ref, cur, features, parts).drop("n_ref", "n_cur")
    gap = F.abs(F.try_divide("cum_ref", "n_ref") - F.try_divide("cum_cur", "n_cur"))
    distances = (
        curve.join(bounded(sizes.select("pos", "n_ref", "n_cur"), len(features)), "pos")
        .groupBy("pos")
        .agg(
            F.max(gap).alias("statistic"),
            F.coalesce(F.sum(gap * (F.col("next_value") - F.col("value"))), F.lit(0.0)).alias("raw_distance"),
        )
    )
    return sizes.join(distances, "pos", "left")


def ks_series(statistic: Column, size: Column, terms: int = 100) -> Column:
    """Chance of a one-sample statistic this large at a large size: the limiting series at a corrected argument."""
    x = F.sqrt(size) * statistic
    z = x + 1 / (6 * F.sqrt(size)) + (x - 1) / (4 * size)
    sign = lambda k: F.when(k % 2 == 1, 1.0).otherwise(-1.0)
    series = F.aggregate(F.sequence(F.lit(1), F.lit(terms)), F.lit(0.0), lambda a, k: a + sign(k) * F.exp(-2.0 * k * k * z * z))
    tail = F.when(size * statistic * statistic > 18, 2 * F.exp(-2.0 * size * statistic * statistic)).otherwise(2 * series)
    p = F.least(F.lit(1.0), F.greatest(F.lit(0.0), tail))
    return F.when(statistic >= 1, 0.0).when(statistic <= 0, 1.0).otherwise(p)


def ks_pvalue(d: float, n: int, m: int, exact_limit: int = EXACT_LIMIT) -> float:
    """Two-sided p-value of the two-sample KS statistic.

    Exact up to 10,000 rows per side; above, the one-sample law at the effective size.
    """
    if not (d > 0):
        return 1.0
    if max(n, m) <= exact_limit:
        return _exact_two_sample(d, n, m)
    return _one_sample(d, round(n * m / (n + m)))


def _exact_two_sample(d: float, n: int, m: int) -> float:
    """Chance that a random merge of both samples ever parts by d or more.

    The walk over (i, j) is followed one merged row at a time; probability that
    reaches a gap of at least d is taken out and summed.
    """
    if m < n:
        n, m = m, n
    g = math.gcd(n, m)
    limit = round(d * (n // g) * m)  # d is a multiple of 1 / lcm(n, m)
    i = np.arange(n + 1)
    mass = np.zeros(n + 1)
    mass[0] = 1.0
    lost = 0.0
    for step in range(n + m):
        j = step - i
        live = (j >= 0) & (j <= m)
        up = np.where(live, mass * (n - i) / (n + m - step), 0.0)
        stay = np.where(live, mass - up, 0.0)
        mass = stay
        mass[1:] += up[:-1]
        after = step + 1 - i
        gap = np.abs(i * (m // g) - after * (n // g))
        out = (gap >= limit) & (mass > 0)
        lost += mass[out].sum()
        mass[out] = 0.0
    return float(min(1.0, lost))


def _one_sample(d: float, n: int) -> float:
    """Survival function of the one-sample statistic at size n."""
    if d >= 1:
        return 0.0
    if n * d * d > 18:
        return min(1.0, 2.0 * math.exp(-2.0 * n * d * d))
    if n > 2000:
        x = math.sqrt(n) * d
        x = x + 1 / (6 * math.sqrt(n)) + (x - 1) / (4 * n)
        return float(min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101)))))
    # Matrix power form of the exact distribution.
    k = int(math.floor(n * d)) + 1
    h = k - n * d
    size = 2 * k - 1
    grid = np.subtract.outer(np.arange(size), np.arange(size))
    mat = (grid >= -1).astype(float)
    powers = h ** np.arange(1, size + 1)
    mat[:, 0] -= powers
    mat[-1, :] -= powers[::-1]
    mat[-1, 0] += max(2 * h - 1, 0.0) ** size
    fact = np.array([math.lgamma(x + 2) if x >= -1 else 0.0 for x in range(-1, size)])
    mat = np.where(grid >= -1, mat * np.exp(-fact[np.clip(grid + 1, 0, size)]), mat)
    scale, out, base, base_scale, power = 0, np.eye(size), mat, 0, n
    while power:
        if power & 1:
            out, scale = out @ base, scale + base_scale
            top = out.max()
            if top > 1e140:
                out, scale = out / 1e140, scale + 140
        base, base_scale = base @ base, 2 * base_scale
        top = base.max()
        if top > 1e140:
            base, base_scale = base / 1e140, base_scale + 140
        power >>= 1
    log_cdf = math.log(max(out[k - 1, k - 1], 1e-300)) + scale * math.log(10) + math.lgamma(n + 1) - n * math.log(n)
    return float(min(1.0, max(0.0, 1.0 - math.exp(log_cdf))))


def ks_pvalues(statistic: Column, n: Column, m: Column, exact_limit: int = EXACT_LIMIT, series_from: int = SERIES_FROM) -> Column:
    """p-value of the two-sample statistic, NULL where that is.

    Large samples are an expression. Only features of small samples, one row each, go to
    the exact laws in a task.
    """

    @F.pandas_udf(T.DoubleType())
    def small(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for d, a, b in batches:
            yield pd.Series([ks_pvalue(float(x), int(i), int(j), exact_limit) if pd.notna(x) else None for x, i, j in zip(d, a, b)], dtype="float64")

    size = F.round(n * m / (n + m))
    large = (F.greatest(n, m) > exact_limit) & (size > series_from)
    return F.when(large, ks_series(statistic, size)).otherwise(small(F.when(~large, statistic), n, m))


def chosen_test(stattest: str, small: int = config.DRIFT_SMALL_SAMPLE):
    fewest = F.least("n_ref", "n_cur")
    auto = F.when(fewest <= small, "ks").otherwise("wasserstein")
    named = auto if stattest == "auto" else F.lit("ks" if stattest == "ks" else "wasserstein")
    return F.when(fewest < 2, "none").otherwise(named)


def feature_drift(
    distances: DataFrame,
    stattest: str = "auto",
    pvalue: float = config.DRIFT_PVALUE,
    distance: float = config.DRIFT_DISTANCE,
    exact_limit: int = EXACT_LIMIT,
    series_from: int = SERIES_FROM,
) -> DataFrame:
    """Test, score, threshold and verdict per feature."""
    tested = distances.withColumn("test", chosen_test(stattest))
    ks, wass = F.col("test") == "ks", F.col("test") == "wasserstein"
    raw, spread = F.col("raw_distance"), F.col("spread")
    size = F.when(spread > 0, F.try_divide(raw, spread)).otherwise(F.when(raw == 0, 0.0).otherwise(F.lit(float("inf"))))
    p = ks_pvalues(F.when(ks, F.col("statistic")), F.col("n_ref"), F.col("n_cur"), exact_limit, series_from)
    scored = tested.withColumn("score", F.when(ks, p).when(wass, size))
    verdict = F.when(ks, F.col("score") < pvalue).when(wass, F.col("score") > distance).otherwise(F.lit(False))
    return scored.select(
        "pos", "feature", "test", "score",
        F.when(ks, F.col("statistic")).alias("statistic"),
        F.when(wass, raw).alias("raw_distance"),
        F.when(ks, F.lit(pvalue)).when(wass, F.lit(distance)).alias("threshold"),
        verdict.alias("drifted"),
        F.when(wass, F.col("score")).when(ks, F.col("statistic")).otherwise(0.0).alias("magnitude"),
        "n_ref", "n_cur",
    )


def drift_verdict(per_feature: DataFrame, share: float = config.DRIFT_SHARE) -> DataFrame:
    moved = F.count_if("drifted")
    return per_feature.agg(
        F.count("*").alias("n_features"), moved.alias("n_drifted_features"), (moved / F.count("*")).alias("drift_share"),
        ((moved / F.count("*")) > F.lit(share)).alias("drift_detected"),
    )


def top_drifted(per_feature: DataFrame, limit: int = 15) -> DataFrame:
    return per_feature.where("drifted").orderBy(F.desc("magnitude"), "pos").limit(limit)


def detect_drift(
    reference: DataFrame | ValueHistogram,
    current: DataFrame | ValueHistogram,
    features: Sequence[str] | None = None,
    stattest: str = "auto",
    share: float = config.DRIFT_SHARE,
    pvalue: float = config.DRIFT_PVALUE,
    distance: float = config.DRIFT_DISTANCE,
    parts: int | None = None,
    exact_limit: int = EXACT_LIMIT,
    series_from: int = SERIES_FROM,
) -> dict[str, DataFrame]:
    """Compare two tables held in the same representation; either may be a kept histogram."""
    names = shared_columns(_named(reference), _named(current), features)
    per_feature = feature_drift(feature_distances(reference, current, names, parts), stattest, pvalue, distance, exact_limit, series_from)
    return {
        "per_feature": per_feature,
        "verdict": drift_verdict(per_feature, share),
        "top": top_drifted(per_feature),
    }


def _named(side: DataFrame | ValueHistogram) -> DataFrame:
    """A frame with the columns of a side; a histogram has none of its rows."""
    if isinstance(side, DataFrame):
        return side
    return local_table(side.counts.sparkSession, [], ", ".join(f"`{f}` double" for f in side.features))


def reference_metadata(snapshot: DataFrame, features: Sequence[str], cls: str = "label_class") -> DataFrame:
    """Rows, feature count and class distribution of a snapshot; one row."""
    per_class = snapshot.groupBy(cls).agg(F.count("*").alias("n"))
    return per_class.agg(
        F.sum("n").alias("reference_rows"),
        F.lit(len(features)).cast("long").alias("feature_count"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(cls, "n")))).alias("class_distribution"),
    )

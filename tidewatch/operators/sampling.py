"""Exact seeded samples with per-stratum quotas.

Rows are ordered inside a stratum by a token, the MD5 of seed and row key, which
any engine can recompute. The quota is met without ranking a whole stratum: the
first 16 token bits cut it into 65536 buckets, bucket counts show where the quota
ends, only that one bucket is ranked, and every other row is kept or left by
comparing its token with the cut. The full-width rows are never shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config
from ..session import bounded, local_table

# More strata than this and the cut table is joined without a broadcast hint.
UNKNOWN = 10**9


def sample_token(key: Sequence[str], seed: int = config.SEED) -> Column:
    text = F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in key])
    return F.md5(text.cast("binary"))


def _bucket(token: Column) -> Column:
    return F.conv(F.substring(token, 1, 4), 16, 10).cast("int")


def stratum_buckets(df: DataFrame, stratum: str, key: Sequence[str], seed: int = config.SEED) -> DataFrame:
    """(stratum, bucket, n): at most 65536 rows per stratum."""
    return (
        df.where(F.col(stratum).isNotNull())
        .select(F.col(stratum), _bucket(sample_token(key, seed)).alias("_bucket"))
        .groupBy(stratum, "_bucket")
        .agg(F.count("*").alias("_n"))
    )


def take_quota(
    df: DataFrame,
    stratum: str,
    key: Sequence[str],
    quota_rule: Callable[[DataFrame], DataFrame],
    seed: int = config.SEED,
    strata: int = UNKNOWN,
    mark: str | None = None,
) -> DataFrame:
    """Keep exactly ``quota`` rows of every stratum, without replacement.

    ``key`` must identify a row. ``quota_rule`` gets (stratum, rows) and returns
    (stratum, quota). Rows without a stratum are never taken. ``strata`` bounds the number of strata where it is known.
    With ``mark`` no row is dropped; a boolean column says which ones are taken.
    """
    hist = stratum_buckets(df, stratum, key, seed)
    sizes = hist.groupBy(stratum).agg(F.sum("_n").alias("rows"))
    quotas = quota_rule(sizes).select(stratum, F.col("quota").cast("long").alias("_quota"))
    upto = F.sum("_n").over(
        Window.partitionBy(stratum).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    )
    edge = (
        hist.withColumn("_upto", upto)
        .join(bounded(quotas, strata), stratum)
        .withColumn("_need", F.col("_quota") - (F.col("_upto") - F.col("_n")))
        .where("_need > 0 AND _need <= _n")
        .select(stratum, "_bucket", "_need")
    )
    order = F.struct(sample_token(key, seed).alias("t"), *[F.col(k) for k in key])
    in_edge = (
        df.select(F.col(stratum), order.alias("_order"))
        .withColumn("_bucket", _bucket(F.col("_order.t")))
        .join(bounded(edge, strata), [stratum, "_bucket"])
    )
    rank = F.row_number().over(Window.partitionBy(stratum, "_bucket").orderBy("_order"))
    cut = in_edge.withColumn("_rank", rank).where("_rank = _need").select(F.col(stratum).alias("_s"), F.col("_order").alias("_cut"))
    how = "left" if mark else "inner"
    joined = df.join(bounded(cut, strata), F.col(stratum) == F.col("_s"), how)
    taken = order <= F.col("_cut")
    if mark:
        return joined.withColumn(mark, F.coalesce(taken, F.lit(False))).drop("_s", "_cut")
    return joined.where(taken).drop("_s", "_cut")


# Quota rules -----------------------------------------------------------------

def _total(sizes: DataFrame) -> DataFrame:
    return sizes.crossJoin(F.broadcast(sizes.agg(F.sum("rows").alias("_all"))))


def truncated_quota(n: int) -> Callable[[DataFrame], DataFrame]:
    """``min(n_c, max(1, int(n_c * n / total)))``"""
    share = F.floor(F.col("rows") * (F.lit(float(n)) / F.col("_all")))
    return lambda sizes: _total(sizes).withColumn("quota", F.least("rows", F.greatest(F.lit(1), share)))


def rounded_quota(n: int) -> Callable[[DataFrame], DataFrame]:
    """``max(1, min(n_c, round(n_c * n / total)))``; everything when the table is small."""
    share = F.bround(F.col("rows") * (F.lit(float(n)) / F.col("_all")), 0).cast("long")
    quota = F.when(F.col("_all") <= n, F.col("rows")).otherwise(F.greatest(F.lit(1), F.least("rows", share)))
    return lambda sizes: _total(sizes).withColumn("quota", quota)


def fixed_quota(n: int) -> Callable[[DataFrame], DataFrame]:
    return lambda sizes: sizes.withColumn("quota", F.least(F.lit(n), "rows"))


def split_quota(stratum: str, test_fraction: float = config.TEST_FRACTION) -> Callable[[DataFrame], DataFrame]:
    """Training rows per class for a stratified split, by largest remainder.

    The test side takes ``ceil(fraction * n)`` rows over the classes with at least
    two rows; a class with a single row goes to training. Ties follow the class
    name. The windows run over one row per class.
    """

    def rule(sizes: DataFrame) -> DataFrame:
        common = F.when(F.col("rows") >= 2, F.col("rows")).otherwise(0)
        everywhere = Window.partitionBy(F.lit(0))
        sized = sizes.withColumns({"_common": common}).withColumn("_all", F.sum("_common").over(everywhere))
        train = F.col("_all") - F.ceil(F.lit(test_fraction) * F.col("_all"))
        share = sized.withColumn("_train", train).withColumn("_exact", F.col("_common") * F.col("_train") / F.col("_all"))
        floors = share.withColumn("_floor", F.floor("_exact")).withColumn("_left", F.col("_train") - F.sum("_floor").over(everywhere))
        by_rest = everywhere.orderBy(F.desc(F.col("_exact") - F.col("_floor")), F.col(stratum))
        extra = (F.row_number().over(by_rest) <= F.col("_left")).cast("int")
        return floors.withColumn("quota", F.when(F.col("rows") < 2, F.col("rows")).otherwise(F.col("_floor") + extra))

    return rule


def attack_mix_quota(rows: int, attack_rate: float, cls: str, mix: dict[str, float] = config.ATTACK_MIX):
    """Rows per class for a target mix, from weights renormalised over available classes.

    Wants are capped by what there is; what attacks leave free goes to BENIGN.
    """
    n_attack = round(rows * attack_rate)

    def rule(sizes: DataFrame) -> DataFrame:
        weights = local_table(sizes.sparkSession, list(mix.items()), f"{cls} string, _w double")
        available = sizes.join(bounded(weights, len(mix)), cls, "left")
        everywhere = Window.partitionBy(F.lit(0))
        want = F.bround(F.lit(n_attack) * F.col("_w") / F.sum("_w").over(everywhere), 0).cast("long")
        attacks = available.withColumn("_want", F.least(want, F.col("rows")))
        left = F.lit(rows) - F.coalesce(F.sum(F.when(F.col("_w").isNotNull(), F.col("_want"))).over(everywhere), F.lit(0))
        quota = F.when(F.col(cls) == config.BENIGN, F.greatest(F.lit(0), F.least(left, F.col("rows")))).otherwise(F.col("_want"))
        return attacks.withColumn("quota", quota).where("quota > 0")

    return rule


def binary_mix_quota(rows: int, attack_fraction: float, flag: str):
    """``n_attack = min(available, round(n * f))`` and benign rows for the rest."""
    wanted = round(rows * attack_fraction)

    def rule(sizes: DataFrame) -> DataFrame:
        attack = F.least(F.lit(wanted), F.coalesce(F.sum(F.when(F.col(flag), F.col("rows"))).over(Window.partitionBy(F.lit(0))), F.lit(0)))
        return sizes.withColumn("_a", attack).withColumn(
            "quota", F.when(F.col(flag), F.col("_a")).otherwise(F.least(F.lit(rows) - F.col("_a"), F.col("rows")))
        )

    return rule


# Samples ---------------------------------------------------------------------

def stratified_sample(df, n, stratum, key, seed=config.SEED, strata=UNKNOWN):
    return take_quota(df, stratum, key, truncated_quota(n), seed, strata)


def reference_sample(df, n, stratum, key, seed=config.SEED, strata=UNKNOWN):
    """Snapshot for drift checks: a rounded stratified sample, or a plain one without labels."""
    if stratum is None or stratum not in df.columns:
        return uniform_sample(df, n, key, seed)
    return take_quota(df, stratum, key, rounded_quota(n), seed, strata)


def uniform_sample(df: DataFrame, n: int, key: Sequence[str], seed: int = config.SEED) -> DataFrame:
    """Exactly ``n`` rows (all, if there are fewer), without replacement."""
    return take_quota(df.withColumn("_one", F.lit(0)), "_one", key, fixed_quota(n), seed, strata=1).drop("_one")


def train_test_split(df, stratum, key, test_fraction=config.TEST_FRACTION, seed=config.SEED, strata=UNKNOWN):
    """Add ``split`` = train / test, stratified by class with exact sizes; null where the class is missing."""
    marked = take_quota(df, stratum, key, split_quota(stratum, test_fraction), seed, strata, mark="_train")
    return marked.withColumn("split", F.when(F.col(stratum).isNotNull(), F.when(F.col("_train"), "train").otherwise("test"))).drop("_train")


def mixed_sample(df, rows, attack_fraction, cls, key, seed=config.SEED):
    """Resample to a target share of attacks."""
    flagged = df.withColumn("_attack", F.col(cls) != config.BENIGN)
    return take_quota(flagged, "_attack", key, binary_mix_quota(rows, attack_fraction, "_attack"), seed, 2).drop("_attack")


def class_mix_sample(df, rows, attack_rate, cls, key, seed=config.SEED, strata=UNKNOWN):
    return take_quota(df, cls, key, attack_mix_quota(rows, attack_rate, cls), seed, strata)


def seeded_shuffle(df: DataFrame, key: Sequence[str], seed: int = config.SEED) -> DataFrame:
    """Row order fixed by the seed; a range-partitioned sort."""
    return df.orderBy(sample_token(key, seed), *key)


def test_rows(n: int, fraction: float = config.TEST_FRACTION) -> int:
    return math.ceil(fraction * n)

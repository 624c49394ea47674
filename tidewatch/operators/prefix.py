"""Running sums over a large ordered group without putting the group into one task.

The rows of a group are cut into ordered buckets by an explicit, deterministic
rule. Each (group, bucket) is summed, the few bucket totals give every bucket its
starting offset, and the window then runs inside one bucket only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import bounded, stored


def ordered_parts(df: DataFrame, order: Sequence[str], parts: int | None = None) -> DataFrame:
    """The rows dealt to ranges of ``order`` and stored, with the number of the range as ``_part``.

    Spark draws the borders from a sample of the rows, whatever the types of the keys, so the ranges hold
    about as many rows each however the keys are spread; equal keys stay together. ``parts`` is the
    number of shuffle partitions where it is not given.
    """
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stored(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()), "ordered")


def row_at(df: DataFrame, order: Sequence[str], position: int, parts: int | None = None) -> DataFrame:
    """The ``order`` columns of the row at a 1-based position, as a frame of one row; of none beyond the end.

    Only the keys are dealt to ranges. Counts of the ranges tell which one holds the position, and only that one is ranked.
    """
    keys = ordered_parts(df.select(*order), order, parts)
    counts = keys.groupBy("_part").agg(F.count("*").alias("_n"))  # a row a range
    upto = F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, 0))
    edge = counts.withColumn("_need", F.lit(position) - (upto - F.col("_n"))).where("_need > 0 AND _need <= _n")
    rank = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return keys.join(F.broadcast(edge), "_part").withColumn("_rank", rank).where("_rank = _need").select(*order)


def position_bucket(position: Column, low: Column, high: Column, buckets: int) -> Column:
    """Equal-width bucket of a dense position such as a feed cursor."""
    width = F.greatest(F.lit(1), F.ceil((high - low + 1) / F.lit(float(buckets))))
    return F.floor((position - low) / width)


def prefix_sums(
    df: DataFrame,
    group: Sequence[str],
    bucket: str,
    order: Sequence[str],
    sums: dict[str, str],
    lead: tuple[str, str] | None = None,
    total_rows: int | None = None,
) -> DataFrame:
    """Add running sums ``{output: input column}`` in ``order`` within ``group``.

    ``bucket`` must grow with ``order``. ``lead=(output, column)`` also adds the
    next row's value across bucket borders. ``total_rows`` bounds the number of
    (group, bucket) pairs where the caller can prove one.
    """
    keys = [*group, bucket]
    totals = [F.sum(src).alias(f"_t_{out}") for out, src in sums.items()]
    firsts = [F.min(lead[1]).alias("_first")] if lead else []
    per_bucket = df.groupBy(*keys).agg(*totals, *firsts)
    across = Window.partitionBy(*group).orderBy(bucket) if group else Window.partitionBy(F.lit(0)).orderBy(bucket)
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bucket.select(
        *keys,
        *[F.coalesce(F.sum(f"_t_{out}").over(before), F.lit(0)).alias(f"_o_{out}") for out in sums],
        *([F.lead("_first").over(across).alias("_next_first")] if lead else []),
    )
    if total_rows is not None:
        offsets = bounded(offsets, total_rows)
    inside = Window.partitionBy(*keys).orderBy(*order)
    running = inside.rowsBetween(Window.unboundedPreceding, 0)
    joined = df.join(offsets, keys)
    out = joined.withColumns({o: F.coalesce(F.sum(src).over(running), F.lit(0)) + F.col(f"_o_{o}") for o, src in sums.items()})
    if lead:
        out = out.withColumn(lead[0], F.coalesce(F.lead(lead[1]).over(inside), F.col("_next_first")))
    return out.drop(*[f"_o_{o}" for o in sums], "_next_first")

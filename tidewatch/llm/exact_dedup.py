"""Exact duplicates by skew-safe combining: local, salted and global groups of whole texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, stored

#: Parts into which every group of equal texts is dealt before the groups meet.
SALTS = 32
#: A group with more than one HOT-th of all rows is looked up by broadcast; there are fewer than HOT such.
HOT = 1000


def exact_duplicates(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; a null text counts as empty.
    The row with the largest doc_id of a group stays. Rows that repeat a doc_id all count
    in group_size and are all kept or all dropped; a null doc_id is smaller than any other.
    An empty table gives an empty one, and other columns are not looked at.

    Rows are combined in their task, then in ``salts`` parts of a digest group, then
    over the parts; every stage groups by digest and full text, so a collision of the
    digest joins nothing. The row that stays is looked up by the digest; two texts behind
    one digest would stop the job instead of giving a wrong row.
    """
    text = lower_ascii(F.coalesce(F.col("text").cast("string"), F.lit("")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("body"))
    rows = rows.withColumn("digest", F.unhex(F.sha2(F.col("body").cast("binary"), 256)))

    ids = stored(rows.select("doc_id", "digest"), "digests")
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int")
    parts = rows.groupBy("digest", salt.alias("salt"), "body").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    whole = parts.groupBy("digest", "body").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    kept = whole.groupBy("digest").agg(
        F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size"), F.count("*").alias("texts"))
    sure = F.when(F.col("texts") > 1, F.raise_error(F.lit("two texts share a SHA-256 digest")).cast("long")).otherwise(F.col("group_size"))
    kept = stored(kept.select("digest", "keep_id", sure.alias("group_size")), "groups")

    # fewer than HOT groups can hold a HOT-th of all rows each; those are broadcast, so no task gets a whole one
    least = ids.count() / HOT
    hot = F.broadcast(kept.where(F.col("group_size") > least).select("digest", F.col("keep_id").alias("hot_id"), F.col("group_size").alias("hot_size")))
    dealt = ids.join(hot, "digest", "left")
    cold = dealt.where("hot_size is null").select("doc_id", "digest").join(kept, "digest")
    out = cold.select("doc_id", "digest", "keep_id", "group_size").union(dealt.where("hot_size is not null").select("doc_id", "digest", "hot_id", "hot_size"))
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
                      F.lower(F.hex("digest")).alias("text_sha256"))

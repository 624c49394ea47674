"""Expressions and small helpers the text operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir

#: Characters that end a word of white space: 0x20 and 0x09 to 0x0D.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` to the cluster's shared folder and read it back, which cuts its lineage."""
    spark = df.sparkSession
    path = shared_dir(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def lower_ascii(text: Column) -> Column:
    """``text`` with A-Z lower-cased and nothing else changed.

    ``lower`` does just that where every character is ASCII. Other texts are cut before
    each of A-Z, where only the first letter of a piece changes; ``translate`` looks every
    character up and takes many times as long.
    """
    first = lambda p: F.substring(p, 1, 1)
    piece = lambda p: F.when(first(p).between("A", "Z"), F.concat(F.lower(first(p)), F.substring(p, F.lit(2), F.length(p)))).otherwise(p)
    pieces = F.array_join(F.transform(F.split(text, "(?=[A-Z])"), piece), "")
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(pieces)


def space_words(text: Column) -> Column:
    """Number of runs of anything but white space; null and empty texts have none."""
    body = F.coalesce(text, F.lit(""))
    return F.size(F.array_remove(F.split(body, SPACE), "")).cast("long")


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text leaves 2 by 4; a null id counts as the text ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def heavy_lookup(rows: DataFrame, known: DataFrame, on: list[str], size: str, parts: int = 1000) -> DataFrame:
    """Inner join of ``rows`` with ``known``, which has each key once and in ``size`` the number of its rows.

    Fewer than ``parts`` keys can hold more than that part of all rows each. Those are looked up by
    broadcast, so no task gets all rows of a key.
    """
    least = known.agg(F.sum(size)).first()[0] or 0
    heavy = F.col(size) * parts > least
    hot = F.broadcast(known.where(heavy).withColumn("__hot", F.lit(True)))
    dealt = rows.join(hot, on, "left")
    columns = [*rows.columns, *[c for c in known.columns if c not in on]]
    cold = dealt.where("__hot is null").select(rows.columns).join(known.where(~heavy), on)
    return dealt.where("__hot").select(columns).union(cold.select(columns))

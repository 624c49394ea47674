"""Mixing sources to target weights: block quotas, a splitting tree over output shards, and permuted blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import bounded
from .common import space_words, stored

#: Weights of the sources in code point order, repeating; a null source is the last.
WEIGHTS = (1, 2, 3)
#: Times that a document is taken at most.
REPEATS = 3
#: Output shards, a power of two, and blocks of a shard on average.
LEVELS, BLOCKS_PER_SHARD = 4, 64
#: Rows of a source that one task puts in order.
BUCKET_ROWS = 2_000


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, n, target) of rows (source, size), one row per source.

    Targets share the total of all sizes by weight and stop at ``REPEATS`` times their
    source's size; what is over goes to the others by weight until none is above. In
    order of cap / weight the capped sources come first, so the level of the others
    follows from running sums. One row per source passes through the window.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (rank % len(WEIGHTS) + 1).cast("int"))
    per = per.withColumn("w", weight.cast("long")).withColumn("cap", F.col("source_size") * REPEATS)
    whole = Window.partitionBy()
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    per = per.select("*", F.sum("source_size").over(whole).alias("total"), F.coalesce(F.sum("cap").over(before), F.lit(0)).alias("capped"),
                     F.sum("w").over(after).alias("w_left"))
    # the first source whose share fits under its cap sets the level for itself and all after it
    fits = (F.col("total") - F.col("capped")) * F.col("w") <= F.col("cap") * F.col("w_left")
    per = per.withColumn("fits", fits)
    level = F.min(F.when(F.col("fits"), F.struct("capped", "w_left"))).over(whole)
    per = per.withColumn("level", level)
    share = (F.col("total") - F.col("level.capped")) * F.col("w")
    target = F.when(share * F.lit(1.0) / F.col("level.w_left") >= F.col("cap"), F.col("cap").cast("double")).otherwise(
        share.cast("double") / F.col("level.w_left").cast("double"))
    return per.select("source", "source_size", "n", target.alias("target"))


def block_quotas(targets: DataFrame, blocks: int) -> DataFrame:
    """(source, source_size, n, target, words, blocks): the words a source gives and its number of blocks.

    ``blocks`` in all are dealt by target; every source that gives words has one at least.
    """
    words = F.round("target").cast("long")
    share = F.col("target") * blocks / F.sum("target").over(Window.partitionBy())
    return targets.select("*", words.alias("words"), F.when(words > 0, F.greatest(F.lit(1), F.round(share))).otherwise(0).cast("long").alias("blocks"))


def splitting_tree(quotas: DataFrame, levels: int, seed: int) -> DataFrame:
    """(source, block, shard): which shard draws which block of a source's permuted words.

    The blocks of all sources start in one node. Every level splits a node in two halves
    of equal size; which of its blocks go left is a uniform draw, so the numbers by source
    follow the multivariate hypergeometric law and add up exactly. A shard then draws its
    number of blocks of a source one after the other from the source's permuted row of
    blocks, so the shards' blocks are disjoint. The tree has shards x blocks of a shard
    rows, which are parameters and do not grow with the documents.
    """
    tokens = quotas.where("blocks > 0").select("source", F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)).alias("token"), F.lit(0).alias("node"))
    for level in range(levels):
        inside = Window.partitionBy("node")
        drawn = inside.orderBy(F.xxhash64(F.lit(seed), F.lit(level), "source", "token"), "source", "token")
        left = F.row_number().over(drawn) <= F.floor((F.count("*").over(inside) + F.pmod(F.col("node"), F.lit(2))) / 2)
        tokens = tokens.select("source", "token", (F.col("node") * 2 + F.when(left, 0).otherwise(1)).alias("node"))
    place = Window.partitionBy("source").orderBy("node", "token")
    return tokens.select("source", (F.row_number().over(place) - 1).alias("block"), F.col("node").alias("shard"))


def permuted(sizes: DataFrame, targets: DataFrame, seed: int) -> DataFrame:
    """Rows of ``sizes`` with start, the words of the source before them in a permuted order, and row, their place.

    Places are drawn by hash. A source is cut into buckets of the hash, bucket sums give
    the offsets, and a task orders one bucket only.
    """
    keyed = sizes.withColumn("key", F.xxhash64(F.lit(seed), "doc_id", "size"))
    parts = targets.select("source", "source_size", "target", "words", "blocks", F.ceil(F.col("n") / BUCKET_ROWS).cast("int").alias("parts"))
    keyed = keyed.alias("x").join(parts.alias("p"), F.col("x.source").eqNullSafe(F.col("p.source")))
    keyed = keyed.select("x.*", "p.source_size", "p.target", "p.words", "p.blocks", "p.parts")
    keyed = keyed.withColumn("bucket", F.pmod(F.shiftright("key", 20), "parts"))
    sums = keyed.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("source", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    rows = keyed.alias("x").join(offsets.alias("o"), F.col("x.source").eqNullSafe(F.col("o.source")) & (F.col("x.bucket") == F.col("o.bucket")))
    rows = rows.select("x.*", "o.offset")
    inside = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size")
    start = F.coalesce(F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("offset")
    return rows.select("*", start.alias("start"), F.row_number().over(inside).alias("row"))


def mix(docs: DataFrame, levels: int = LEVELS, blocks_per_shard: int = BLOCKS_PER_SHARD, seed: int = 7) -> DataFrame:
    """Pieces of the mix: doc_id, source, size, source_size, target, row (struct), shard, block, times, first_word, n_words, place.

    ``docs`` has doc_id, text and source. A source's documents stand one after the other
    in a permuted order, repeated up to ``REPEATS`` times; its first round(target) words are the
    mix. Equal ranges of them are its blocks, and the splitting tree gives each block to
    a shard. A piece is the part of a document (words first_word up to first_word +
    n_words of pass ``times``) within one block; ``place`` orders a shard after its local shuffle. So every
    source gives its target to the word, and at most one document per block border is cut.

    Documents without words, null texts among them, have one piece of no words and no
    shard. A null source is a source of its own; rows that repeat a doc_id are rows like
    others. Where all sizes are 0 nothing is taken, and an empty table gives an empty one.
    """
    sizes = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
                               space_words(F.col("text").cast("string")).alias("size")), "sizes")
    shards = 2**levels
    quotas = stored(block_quotas(source_targets(sizes), shards * blocks_per_shard), "quotas")
    tree = stored(splitting_tree(quotas, levels, seed), "tree")
    rows = permuted(sizes, quotas, seed).withColumn("times", F.explode(F.sequence(F.lit(0), F.lit(REPEATS - 1))))
    low = F.col("times") * F.col("source_size") + F.col("start")
    rows = rows.withColumn("low", low).withColumn("high", F.least(F.col("low") + F.col("size"), "words"))
    taken = (F.col("high") > F.col("low")) & (F.col("blocks") > 0)
    # block b holds the words from ceil(b * words / blocks) on
    of = lambda word: F.expr(f"({word}) * blocks div words")
    first, last = F.when(taken, of("low")), F.when(taken, of("high - 1"))
    rows = rows.withColumn("block", F.explode_outer(F.when(taken, F.sequence(first, last)))).where("block is not null or times = 0")
    rows = rows.withColumn("begin", F.expr("(block * words + blocks - 1) div blocks")).withColumn("end", F.expr("((block + 1) * words + blocks - 1) div blocks"))
    n = F.when(F.col("x.block").isNotNull(), F.least("high", "end") - F.greatest("low", "begin")).otherwise(0)
    few = bounded(tree, tree.count())
    out = rows.alias("x").join(few.alias("t"), F.col("x.source").eqNullSafe(F.col("t.source")) & (F.col("x.block") == F.col("t.block")), "left")
    return out.select("x.doc_id", "x.source", "x.size", "x.source_size", "x.target", F.struct("x.bucket", "x.row").alias("row"), "t.shard", "x.block", "x.times",
                      F.when(F.col("x.block").isNotNull(), F.greatest("x.low", "x.begin") - F.col("x.low")).otherwise(0).cast("long").alias("first_word"), n.cast("long").alias("n_words"),
                      F.xxhash64(F.lit(seed), "t.shard", "x.times", "x.key", "x.block").alias("place"))


def mixed(docs: DataFrame, levels: int = LEVELS, blocks_per_shard: int = BLOCKS_PER_SHARD, seed: int = 7) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target, taken, shards; see ``mix``."""
    pieces = mix(docs, levels, blocks_per_shard, seed)
    return pieces.groupBy("row", "source", "doc_id", "size", "source_size", "target").agg(
        F.sum("n_words").alias("taken"), F.array_sort(F.collect_set("shard")).alias("shards")).drop("row")


def write_shards(pieces: DataFrame, path: str) -> None:
    """Write the pieces by shard, each in the order of its local shuffle."""
    dealt = pieces.where("shard is not null").repartition("shard", F.col("block"))
    dealt.sortWithinPartitions("shard", "place").write.partitionBy("shard").parquet(path)

"""The trie of shared conversation beginnings, rolled up in bands of depth.

Turns meet their conversation once, in order, and a chained digest names the prefix that
ends with each of them; a task streams through them and holds one conversation's current
digest and the digests above it in the band, however long the conversation is. Prefixes
are grouped to nodes with partial counts, so a beginning that very many share costs a row a task.

Subtree sums go up in bands of ``BAND`` levels, the deepest band first. A node adds its
values to its ancestors inside its band only, at most ``BAND`` rows. The completed totals of a
band's topmost nodes then go to the ancestors in the band above, again at most ``BAND`` rows
each. So a trie of depth d takes d / BAND rounds and no node explodes to its whole path.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import heavy_lookup, space_words, stored

#: Levels of a band.
BAND = 8
#: Conversations in the group that lends its first turns; one in FAMILY is the lender.
FAMILY = 20
#: A conversation borrows fewer turns than this.
BORROWED = 4
#: Ids of one chunk of a list of conversations.
CHUNK = 4096
#: Rows a task hands on at once.
OUT_ROWS = 20_000


def borrowed(conv_id: Column) -> Column:
    """Turns that a conversation takes from its family's lender: crc32 of the decimal id, modulo 4."""
    return F.crc32(conv_id.cast("string").cast("binary")) % BORROWED


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv_id, at, digest, words): the turns of rebuilt conversations in order of ``at``; at = 0 is the start of each.

    The first h turns of the lender come first, then the conversation's own after its
    first h; both keep their places, so no turn needs to be counted again.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    body = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.unhex(F.sha2(body.cast("binary"), 256)).alias("digest"), space_words(text).alias("words"))
    order = W.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "digest")
    own = stored(turns.withColumn("at", F.row_number().over(order).cast("long")).drop("turn"), "turns")
    convs = own.select("conv_id").distinct()
    lent = own.where((F.col("at") < BORROWED) & (F.col("conv_id") % FAMILY == 0)).withColumnRenamed("conv_id", "lender")
    first = convs.withColumn("lender", F.col("conv_id") - F.col("conv_id") % FAMILY).join(lent, "lender")
    first = first.where(F.col("at") <= borrowed(F.col("conv_id")))
    rest = own.where(F.col("at") > borrowed(F.col("conv_id")))
    start = convs.withColumns({"at": F.lit(0).cast("long"), "digest": F.lit(None).cast("binary"), "words": F.lit(0).cast("long")})
    columns = ["conv_id", "at", "digest", "words"]
    return start.select(columns).union(first.select(columns)).union(rest.select(columns))


_KEY = "struct<x:bigint,y:bigint>"
_PREFIXES = f"conv_id long, x long, y long, px long, py long, depth long, words long, ends boolean, path array<{_KEY}>, above array<{_KEY}>"


def _chained(band: int):
    """Prefixes of conversations that come sorted by (conv_id, at): each with its ancestors in the band, itself last."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["conv_id", "x", "y", "px", "py", "depth", "words", "ends", "path", "above"]
        conv, key, depth, path, above = None, b"", 0, [], []
        held, out = None, []
        for part in parts:
            for c, digest, words in zip(part["conv_id"].tolist(), part["digest"].tolist(), part["words"].tolist()):
                if c != conv:
                    conv, depth, key, path, above = c, 0, hashlib.sha256(b"root").digest(), [], []
                    parent = (None, None)
                    if held:
                        held[7] = True
                else:
                    parent = struct.unpack(">qq", key[:16])
                    depth += 1
                    key = hashlib.sha256(key + digest).digest()
                    if depth % band == 0:
                        path, above = [], path
                x, y = struct.unpack(">qq", key[:16])
                path = [*path, {"x": x, "y": y}]
                if held:
                    out.append(held)
                held = [c, x, y, *parent, depth, words, False, path, above if depth % band == 0 else None]
                if len(out) >= OUT_ROWS:
                    yield pd.DataFrame(out, columns=names, dtype=object)
                    out = []
        if held:
            held[7] = True
            out.append(held)
        if out:
            yield pd.DataFrame(out, columns=names, dtype=object)

    return run


def prefixes(conversations: DataFrame, band: int = BAND) -> DataFrame:
    """One row for every rebuilt conversation and each of its prefixes, the empty one included."""
    turns = rebuilt(conversations).repartition("conv_id").sortWithinPartitions("conv_id", "at")
    return turns.mapInPandas(_chained(band), _PREFIXES)


def _digests(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """SHA-256 of each node's chunks, which come sorted; the state is one running digest."""
    node, running, out = None, None, []
    for part in parts:
        for x, y, text in zip(part["x"].tolist(), part["y"].tolist(), part["text"].tolist()):
            if (x, y) != node:
                if node is not None:
                    out.append((*node, running.hexdigest()))
                node, running = (x, y), hashlib.sha256(text.encode())
            else:
                running.update(b"," + text.encode())
        if len(out) >= OUT_ROWS:
            yield pd.DataFrame(out, columns=["x", "y", "ends_sha256"])
            out = []
    if node is not None:
        out.append((*node, running.hexdigest()))
    if out:
        yield pd.DataFrame(out, columns=["x", "y", "ends_sha256"])


def ends_digest(ends: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(x, y, ends_sha256) of the sorted, comma-joined ids that end at each node.

    Ids are joined to texts of up to ``chunk`` neighbouring ids on many tasks first. A digest is sequential, so a
    node's texts pass one task, but one after the other: it holds none of them.
    """
    piece = F.floor(F.col("conv_id") / chunk) if chunk & (chunk - 1) else F.shiftright("conv_id", chunk.bit_length() - 1)
    texts = ends.groupBy("x", "y", piece.alias("piece")).agg(F.array_join(F.array_sort(F.collect_list("conv_id")), ",").alias("text"))
    texts = texts.repartition("x", "y").sortWithinPartitions("x", "y", "piece")
    return texts.mapInPandas(_digests, "x long, y long, ends_sha256 string")


def band_rollup(nodes: DataFrame, values: list[str], band: int = BAND) -> DataFrame:
    """(x, y, values): sums over each node's subtree, itself included.

    ``nodes`` has (x, y, depth, path, above): path holds the node's ancestors from the top of its band to itself,
    above, for nodes at the top of a band, those of the band before.
    """
    deepest = nodes.agg(F.max("depth")).first()[0]
    if deepest is None:
        return nodes.select("x", "y", *values)
    sums = [F.sum(v).alias(v) for v in values]
    carried, done = None, None
    for b in range(deepest // band, -1, -1):
        here = nodes.where((F.col("depth") >= b * band) & (F.col("depth") < (b + 1) * band))
        given = here.select(F.explode("path").alias("n"), *values).select("n.x", "n.y", *values)
        if carried is not None:
            given = given.union(carried)
        totals = stored(given.groupBy("x", "y").agg(*sums), "band-totals")
        done = totals if done is None else done.union(totals)
        if b:
            tops = here.where(F.col("depth") == b * band).select("x", "y", "above")
            carried = tops.join(totals, ["x", "y"]).select(F.explode("above").alias("n"), *values).select("n.x", "n.y", *values)
    return done


def prefix_trie(conversations: DataFrame, band: int = BAND) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``conversations`` has conv_id, turn, role and text. Turns are ordered by turn, null first, ties by the
    digest of role and text; repeated rows are turns of their own. Null roles and texts are empty.
    Every conv_id is rebuilt: the first h = crc32(conv_id) % 4 turns come from conversation conv_id - conv_id % 20 (fewer
    where it has fewer), the rest are its own after the first h. Rows without conv_id belong to no conversation.
    A node is a distinct sequence of first turns, from the empty one. Very long texts are
    digested where they are read; very long conversations stream through a task. An empty table gives an empty one,
    other columns are not looked at.
    """
    rows = stored(prefixes(conversations, band), "prefixes")
    nodes = rows.groupBy("x", "y").agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.first("px").alias("px"), F.first("py").alias("py"),
        F.first("depth").alias("depth"), F.first("words").alias("words"), F.first("path").alias("path"), F.first("above").alias("above"))
    nodes = stored(nodes, "trie-nodes")
    children = nodes.where("px is not null").groupBy(F.col("px").alias("x"), F.col("py").alias("y")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, ["x", "y"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = nodes.withColumn("n_leaves", (F.col("n_children") == 0).cast("long")).withColumn("saved_tokens", (F.col("n_convs") - 1) * F.col("words"))
    nodes = stored(nodes, "trie-values")
    totals = band_rollup(nodes, ["n_leaves", "saved_tokens"], band)
    ends = ends_digest(rows.where("ends").select("x", "y", "conv_id"))
    facts = nodes.drop("n_leaves", "saved_tokens", "path", "above", "words").join(totals, ["x", "y"]).join(ends, ["x", "y"], "left")
    facts = stored(facts, "trie-facts")
    # a node with very many children is looked up by broadcast
    parents = facts.where("n_children > 0").select(F.col("x").alias("px"), F.col("y").alias("py"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("__children"))
    below = heavy_lookup(facts.where("px is not null"), parents, ["px", "py"], "__children").drop("__children")
    root = facts.where("px is null").withColumn("parent_conv_id", F.lit(None).cast("long"))
    empty = hashlib.sha256(b"").hexdigest()
    return root.union(below.select(root.columns)).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256"))

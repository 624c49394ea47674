"""Cross-site boilerplate lines by HyperLogLog sketches of the sites each line stands on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Sites on which a line must stand to be boilerplate.
MIN_SITES = 10
#: log2 of the registers of a sketch: a standard error of about 1.6 %.
LG_K = 12
#: Counts this share of the threshold away from it are settled by the sketch: six standard errors.
MARGIN = 0.1


def _lines(docs: DataFrame) -> DataFrame:
    """(row_id, doc_id, site, at, h, k) of the lines that are not blank; h and k make a digest of the trimmed line."""
    lines = docs.select("row_id", "doc_id", "site", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    lines = lines.withColumn("line", F.btrim("line", F.lit(" \t\r\x0b\x0c"))).where(F.col("line") != "")
    return lines.select("row_id", "doc_id", "site", "at", F.xxhash64("line").alias("h"), F.xxhash64(F.lit(1), "line").alias("k"))


def boilerplate(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """(h, k, sites, first): digests of lines on at least ``min_sites`` sites and their first (doc_id, at).

    Sketches merge in every task before they are shuffled, so a line of most documents
    costs a row per task. Lines whose estimate is near the threshold are counted exactly.
    """
    lines = _lines(docs)
    spread = lines.groupBy("h", "k").agg(
        F.hll_sketch_agg("site", LG_K).alias("sketch"), F.count("*").alias("n"), F.min(F.struct("doc_id", "at")).alias("first"))
    # n bounds the sites from above, so rarer lines need no estimate
    spread = spread.where(F.col("n") >= min_sites).select("h", "k", "first", F.hll_sketch_estimate("sketch").alias("sites"))
    spread = stored(spread.where(F.col("sites") >= min_sites * (1 - MARGIN) - 1), "line-spread")
    near = F.col("sites") <= min_sites * (1 + MARGIN) + 1
    exact = lines.select("h", "k", "site").where("site is not null").join(spread.where(near).select("h", "k"), ["h", "k"])
    exact = exact.distinct().groupBy("h", "k").agg(F.count("*").alias("exact"))
    counted = spread.where(near).drop("sites").join(exact, ["h", "k"]).where(F.col("exact") >= min_sites)
    sure = spread.where(~near).select("h", "k", "sites", "first")
    return sure.union(counted.select("h", "k", F.col("exact").alias("sites"), "first"))


def line_dedup(docs: DataFrame, min_sites: int = MIN_SITES, keep_columns: bool = False, drop_emptied: bool = False) -> DataFrame:
    """Texts without cross-site boilerplate lines: doc_id, n_lines, n_removed, text; one row per row of ``docs``.

    ``docs`` has doc_id, text and source, the site. A line is compared without the white
    space around it; blank lines are never boilerplate, and a null site is no site. The
    first occurrence of a line (smallest doc_id, null first, then place) stays, so no content is lost;
    all others go with their line ends. Null texts stay null with 0 lines. Rows that
    repeat a doc_id are told apart by their texts; rows that are equal are cleaned alike.
    With ``keep_columns`` the columns of ``docs`` are returned, and text is the cleaned one;
    with ``drop_emptied`` rows go that lost lines and have no other text.
    """
    row_id = F.struct(F.col("doc_id").alias("a"), F.xxhash64("text").alias("b"))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("source").cast("string").alias("site"))
    base = base.withColumn("row_id", F.xxhash64(row_id))
    common = boilerplate(base, min_sites)
    gone = _lines(base).join(common.select("h", "k", "first"), ["h", "k"])
    gone = gone.where(~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("at") == F.col("first.at"))))
    gone = gone.groupBy("row_id").agg(F.collect_set("at").alias("__gone"))
    full = docs.withColumn("__row", F.xxhash64(F.struct(F.col("doc_id").cast("long").alias("a"), F.xxhash64(F.col("text").cast("string")).alias("b"))))
    out = full.join(gone.withColumnRenamed("row_id", "__row"), "__row", "left")
    lines = F.split(F.col("text").cast("string"), "\n")
    left = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains("__gone", i)), "\n")
    text = F.when(F.col("__gone").isNull(), F.col("text").cast("string")).otherwise(left)
    if drop_emptied:
        out = out.where(F.col("__gone").isNull() | left.rlike(r"\S"))
    if keep_columns:
        return out.select(*[text.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns])
    n = F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size(lines))
    return out.select("doc_id", n.cast("long").alias("n_lines"), F.coalesce(F.size("__gone"), F.lit(0)).cast("long").alias("n_removed"), text.alias("text"))

"""Benchmark decontamination by winnowing: shared fingerprints, joined and extended to whole windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import bounded
from .common import lower_ascii, stored

#: Consecutive words of an item that make a window.
SPAN = 10
#: Words of a fingerprint. A window of SPAN words holds SPAN - GRAM + 1 of them, the
#: number over which winnowing keeps the least: each window keeps one at least.
GRAM = 5
_NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words of ASCII letters, digits and all other characters beyond ASCII, after lower-casing A-Z."""
    return F.array_remove(F.split(lower_ascii(F.coalesce(text.cast("string"), F.lit(""))), _NO_WORD), "")


def _shifted(name: str, by: int) -> Column:
    return F.slice(name, by + 1, F.greatest(F.size(name) - by, F.lit(0)))


def _sliding(rows: DataFrame, name: str, wide: int, pick: Callable[[Column, Column], Column], out: str) -> DataFrame:
    """Adds ``out``: ``pick`` over every ``wide`` neighbours of array ``name``, by doubling the width.

    Each step takes whole arrays as arguments, so no lambda looks into another column.
    """
    done, now = 1, name
    while done < wide:
        step = min(done, wide - done)
        short = F.greatest(F.size(now) - step, F.lit(0))
        rows = rows.withColumn(f"{out}_{done}", F.zip_with(F.slice(now, 1, short), _shifted(now, step), pick))
        done, now = done + step, f"{out}_{done}"
    return rows.withColumn(out, F.col(now))


def _hashed(rows: DataFrame, span: int, gram: int, out: str) -> DataFrame:
    """Adds ``out``, the hashes of all k-grams of words; null where there are fewer words than ``span``."""
    n = F.size("words")
    at = F.when(n >= span, F.sequence(F.lit(0), n - gram))
    return rows.withColumn(out, F.transform(at, lambda i: F.xxhash64(*[F.get("words", i + k) for k in range(gram)])))


def _least(rows: DataFrame, span: int, gram: int, out: str) -> DataFrame:
    """Adds ``out``, the least hash of every window of span - gram + 1 k-grams."""
    rows = _hashed(rows, span, gram, f"{out}_h")
    return _sliding(rows, f"{out}_h", span - gram + 1, lambda x, y: F.least(x, y), out)


def fingerprints(rows: DataFrame, span: int, gram: int) -> DataFrame:
    """(id, pos, print, before, gram, after) of every fingerprint of rows (id, words).

    A k-gram is kept where its hash is the least of some window of span - gram + 1
    k-grams: the least over windows, then the greatest of those over the windows that
    hold a place, equals the hash just there. ``before`` and ``after`` hold the words
    that may belong to a window with this k-gram.
    """
    wide, side = span - gram + 1, span - gram
    rows = _least(rows.select("id", "words"), span, gram, "low")
    # windows beyond either end count for nothing in the greatest
    edge = F.array_repeat(F.lit(-(2**63)).cast("long"), wide - 1)
    rows = rows.withColumn("padded", F.concat(edge, "low", edge))
    rows = _sliding(rows, "padded", wide, lambda x, y: F.greatest(x, y), "top")
    kept = F.transform(F.zip_with("low_h", "top", lambda x, y: F.when(x == y, x)), lambda x, i: F.struct(i.alias("pos"), x.alias("print")))
    kept = F.filter(kept, lambda x: x["print"].isNotNull())
    part = lambda x: F.struct(
        x["pos"].alias("pos"), x["print"].alias("print"),
        F.slice("words", F.greatest(x["pos"] - side, F.lit(0)) + 1, F.least(x["pos"], F.lit(side))).alias("before"),
        F.slice("words", x["pos"] + 1, gram).alias("gram"), F.slice("words", x["pos"] + gram + 1, side).alias("after"))
    return rows.select("id", F.explode(F.transform(kept, part)).alias("f")).select("id", "f.*")


def row_key(docs: DataFrame) -> Column:
    """Tells rows of ``docs`` apart by doc_id, null or not, and text; equal rows share a key."""
    return F.xxhash64(F.struct(F.col("doc_id").cast("long").alias("a"), F.xxhash64(F.col("text").cast("string")).alias("b")))


def matches(docs: DataFrame, items: DataFrame, spans: list[tuple[int, int]]) -> DataFrame:
    """(id, doc_id, n_words, hit): a row with a null hit for every row of ``docs``, and one more for each shared fingerprint.

    The one scan that all documents take. Fingerprints alone are compared here, of which
    an item's are few; documents are not shuffled where those of the items are a broadcast's size.
    """
    prints = None
    for span, gram in spans:
        one = _least(items.where(F.size("words") == span if span == gram else F.size("words") >= span), span, gram, "low")
        one = one.select(F.explode("low").alias("print"), F.lit(True).alias("hit"))
        prints = one if prints is None else prints.union(one)
    prints = stored(prints.distinct(), "item-prints")
    rows, found = docs, []
    for k, (span, gram) in enumerate(spans):
        rows = _least(rows, span, gram, f"low{k}")
        found.append(F.coalesce(F.array_distinct(f"low{k}"), F.array().cast("array<long>")))
    alone = F.array(F.lit(None).cast("long"))
    rows = rows.select("id", "doc_id", F.size("words").cast("long").alias("n_words"), F.explode(F.concat(alone, *found)).alias("print"))
    return rows.join(bounded(prints, prints.count()), "print", "left").where("print is null or hit").select("id", "doc_id", "n_words", "hit")


def _common(a: Column, b: Column) -> Column:
    """Length of the common beginning of two arrays."""
    same = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y))
    end = F.array_position(same, False)
    return F.when(end > 0, end - 1).otherwise(F.size(same)).cast("int")


def hits(docs: DataFrame, items: DataFrame, span: int, gram: int) -> DataFrame:
    """(id, item, low, high): word ranges of documents within occurrences of windows of ``items`` (id, words)."""
    test = stored(fingerprints(items, span, gram).select(
        F.col("id").alias("item"), "print", F.col("before").alias("i_before"), F.col("gram").alias("i_gram"), F.col("after").alias("i_after")), "item-prints")
    test = test.distinct()
    met = fingerprints(docs, span, gram).join(bounded(test, test.count()), "print").where(F.col("gram") == F.col("i_gram"))
    left = _common(F.reverse("before"), F.reverse("i_before"))
    right = _common(F.col("after"), F.col("i_after"))
    met = met.select("id", "item", (F.col("pos") - left).alias("low"), (F.col("pos") + gram + right).alias("high"))
    return met.where(F.col("high") - F.col("low") >= span)


def contamination(docs: DataFrame, items: DataFrame, span: int = SPAN, gram: int = GRAM, with_key: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_hit, n_items, item_ids, contaminated.

    ``docs`` has doc_id and text, ``items`` has item_id and text. A window is ``span``
    consecutive words of an item; an item of fewer words, but not none, is one window. A
    document's word inside any occurrence of a window is hit. Every shared window is
    found: it holds a kept fingerprint, and hits are confirmed word by word. Items shorter than
    ``span`` are looked up by their whole length, one pass for each such length.

    Null texts have no words. A null item_id takes part but cannot be listed. Rows that
    repeat a doc_id, or have none, are told apart by their texts; repeated items
    count once. Empty tables give no hits. Other columns are not looked at. With ``with_key``
    there is one more column ``row_key``, as the function of that name makes it.
    """
    base = docs.select(row_key(docs).alias("id"), F.col("doc_id").cast("long").alias("doc_id"), words_of(F.col("text")).alias("words"))
    test = stored(items.select(F.col("item_id").cast("string").alias("id"), words_of(F.col("text")).alias("words")).where(F.size("words") > 0), "items")
    lengths = [r[0] for r in test.select(F.size("words").alias("n")).where(f"n < {span}").distinct().collect()]  # under span of them
    spans = [(span, gram), *((n, n) for n in sorted(lengths))]
    met = stored(matches(base, test, spans), "matches")
    some = stored(met.where("hit").select("id").distinct(), "matched")
    raw = docs.select(row_key(docs).alias("id"), "text")
    near = raw.join(bounded(some, some.count()), "id", "left_semi")
    near = near.select("id", words_of(F.col("text")).alias("words"))
    found = None
    for n, k in spans:
        one = hits(near, test.where(F.size("words") == n if n == k else F.size("words") >= n), n, k)
        found = one if found is None else found.union(one)
    found = stored(found.distinct(), "hits")

    reach = Window.partitionBy("id").orderBy("low", "high").rowsBetween(Window.unboundedPreceding, -1)
    spans = found.select("id", "low", "high").distinct().withColumn("until", F.coalesce(F.max("high").over(reach), F.lit(0)))
    n_hit = spans.groupBy("id").agg(F.sum(F.greatest(F.col("high") - F.greatest("low", "until"), F.lit(0))).alias("n_hit"))
    ids = found.groupBy("id").agg(F.array_sort(F.collect_set("item")).alias("item_ids"))
    per = n_hit.join(ids, "id")
    out = met.where("hit is null").join(per, "id", "left")
    n = F.coalesce("n_hit", F.lit(0)).cast("long")
    listed = F.coalesce("item_ids", F.array().cast("array<string>"))
    key = [F.col("id").alias("row_key")] if with_key else []
    return out.select(*key, "doc_id", "n_words", n.alias("n_hit"), F.size(listed).cast("long").alias("n_items"),
                      listed.alias("item_ids"), (n > 0).alias("contaminated"))

"""URL verdicts by given host rules and by association rules mined from labelled URLs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import bounded, local_table
from .common import lower_ascii, stored

#: Given rules: verdict, host, path.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
         ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: Share of labelled URLs that must hold a combination, and of those that are to be blocked.
MIN_SUPPORT, MIN_CONFIDENCE = 0.01, 0.9
#: Given rules are broadcast as a literal map only up to this number.
MAX_GIVEN = 10_000
BLOCKED = "=block"


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): host up to the first of / ? # after the first ://, A-Z lower-cased; path up to ? or #."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"\A([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)
    return lower_ascii(host), path


def given_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """The longest rule (host and path together) that fits, as struct<rule, verdict>, or null.

    Among equally long rules the one with the longer host, then the smaller text, is taken.
    """
    if len(rules) > MAX_GIVEN:
        raise ValueError(f"at most {MAX_GIVEN} given rules")
    order = sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r[1] + r[2]))
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in reversed(order):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        found = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def url_tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens: scheme, labels of the host, words of the path, names of the query, and a fragment's presence."""
    words = lambda text, by: F.array_remove(F.split(text, by), "")
    tag = lambda kind, parts: F.transform(parts, lambda x: F.concat(F.lit(kind), x))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    every = F.concat(
        tag("scheme:", words(F.lower(F.regexp_extract(url, r"\A([A-Za-z][A-Za-z0-9+.-]*)://", 1)), "/")),
        tag("host:", words(host, r"\.")), tag("path:", words(path, r"[/._-]+")),
        tag("query:", words(F.regexp_replace(query, r"=[^&]*", ""), "&")),
        F.when(url.contains("#"), F.array(F.lit("fragment"))).otherwise(F.array().cast("array<string>")))
    return F.array_distinct(F.coalesce(every, F.array().cast("array<string>")))


def token_classes(labelled: DataFrame, min_support: float = MIN_SUPPORT) -> DataFrame:
    """(token, name): tokens of ``labelled`` (tokens, blocked) that enough blocked rows hold; tokens of the same rows share a name.

    Tokens that always come together tell the same, and k of them would be in 2^k frequent sets.
    A token's rows are known by their number and by sums of two hashes of what they hold. A row has a bounded
    number of tokens, so at most that number over ``min_support`` tokens are left.
    """
    known = labelled.where("blocked is not null").withColumn("tokens", F.array_sort(F.array_distinct("tokens")))
    least = F.ceil(F.lit(min_support) * F.lit(known.count()))
    wide = lambda *x: F.sum(F.xxhash64(*x).cast("decimal(20,0)"))
    rows = known.select("tokens", "blocked", F.explode("tokens").alias("token"))
    held = rows.groupBy("token").agg(F.count("*").alias("n"), F.count_if("blocked").alias("b"), wide("tokens").alias("x"), wide(F.lit(1), "tokens").alias("y"))
    held = held.where((F.col("b") > 0) & (F.col("b") >= least))
    same = W.partitionBy("n", "b", "x", "y")
    return stored(held.select("token", F.min("token").over(same).alias("name")), "token-classes")


def in_classes(rows: DataFrame, key: str, classes: DataFrame) -> DataFrame:
    """``rows`` (key, tokens, ..) with the distinct names of their tokens' classes; a row without any has none."""
    each = rows.select(key, F.explode("tokens").alias("token")).join(bounded(classes, classes.count()), "token")
    named = each.groupBy(key).agg(F.collect_set("name").alias("tokens"))
    return rows.drop("tokens").join(named, key, "left").withColumn("tokens", F.coalesce("tokens", F.array().cast("array<string>")))


def mine_rules(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Rules (tokens, confidence) for blocking from ``labelled`` (tokens, blocked), by parallel FP-growth.

    Rules may have any number of tokens. A rule whose tokens hold those of a shorter one is
    pruned: that one fires anyway. A longer one may be sure enough where no part of it is.
    No labelled rows, or none blocked, give no rules. A null label is no label.
    """
    baskets = labelled.where("blocked is not null").select(
        F.when(F.col("blocked"), F.array_append("tokens", F.lit(BLOCKED))).otherwise(F.col("tokens")).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(baskets)
    rules = model.associationRules.where(F.element_at("consequent", 1) == BLOCKED)
    rules = stored(rules.select(F.array_sort("antecedent").alias("tokens"), "confidence"), "mined-rules")
    # a shorter rule stands under the token that the fewest rules hold, which a longer one must hold, too
    each = rules.select("tokens", F.explode("tokens").alias("token"))
    rare = each.groupBy("token").agg(F.count("*").alias("n"))
    short = each.join(rare, "token").groupBy(F.col("tokens").alias("part")).agg(F.min_by("token", F.struct("n", "token")).alias("token"))
    inside = each.join(short, "token").where((F.size("part") < F.size("tokens")) & (F.size(F.array_except("part", "tokens")) == 0))
    return rules.join(inside.select("tokens").distinct(), "tokens", "left_anti")


def fired(pages: DataFrame, rules: DataFrame, counts: DataFrame) -> DataFrame:
    """page_id of rows (row_id, tokens) of ``pages`` for which a rule fires.

    Inverted index: a rule stands under its rarest token alone, so a token that most URLs
    share is looked up only where no rarer one is in the rule.
    """
    token = rules.select("tokens", F.explode("tokens").alias("token")).join(counts, "token")
    index = token.groupBy("tokens").agg(F.min_by("token", F.struct("n", "token")).alias("token"))
    n = index.count()
    hits = pages.select("row_id", F.col("tokens").alias("has"), F.explode("tokens").alias("token")).join(bounded(index, n), "token")
    return hits.where(F.size(F.array_except("tokens", "has")) == 0).select("row_id").distinct()


def url_verdicts(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, labels: DataFrame | None = None,
                 min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """One row per row of ``pages`` (page_id, url): page_id, host, path, rule, verdict.

    A given rule decides where one fits, the longest first. The other URLs are blocked
    where a mined rule fires, else allowed. ``labels`` (page_id, blocked) teaches the
    mined rules; where it is None, the URLs that given rules decide are the labelled ones.
    Null and malformed URLs have an empty host and path, hold no token a rule could meet
    and are allowed; very long URLs are read whole. Rows that repeat a page_id or url are judged alike; a label of a
    null page_id teaches nothing. An empty table gives an empty one.
    """
    url = F.col("url").cast("string")
    host, path = url_parts(url)
    base = pages.select(F.col("page_id"), url.alias("url"), host.alias("host"), path.alias("path"))
    given = given_rule(F.col("host"), F.col("path"), rules)
    base = base.withColumn("given", given)
    tokens = F.when(F.col("host") != "", url_tokens(F.col("url"), F.col("host"), F.col("path"))).otherwise(F.array().cast("array<string>"))
    # rows of one url are judged once
    distinct = base.where("url is not null").select("url", "given", tokens.alias("tokens")).dropDuplicates(["url"])
    if labels is None:
        labelled = distinct.where("given is not null").select("url", "tokens", (F.col("given.verdict") == "block").alias("blocked"))
    else:
        known = labels.select(F.col("page_id"), F.col("blocked").cast("boolean").alias("blocked")).where("page_id is not null and blocked is not null")
        known = known.groupBy("page_id").agg(F.max("blocked").alias("blocked"))
        labelled = base.join(known, "page_id").select("url", tokens.alias("tokens"), "blocked")
    classes = token_classes(labelled, min_support)
    # rows of one url hold the same tokens, so they are named once
    named = in_classes(labelled.select("url", "tokens").dropDuplicates(["url"]), "url", classes)
    labelled = stored(labelled.drop("tokens").join(named, "url"), "labelled")
    mined = mine_rules(labelled, min_support, min_confidence)
    counts = labelled.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    open_rows = in_classes(distinct.where("given is null").select(F.col("url").alias("row_id"), "tokens"), "row_id", classes)
    hit = fired(open_rows, mined, counts).select(F.col("row_id").alias("url"), F.lit(True).alias("hit"))
    out = base.join(hit, "url", "left")
    verdict = F.coalesce(F.col("given.verdict"), F.when(F.col("hit"), F.lit("block")).otherwise(F.lit("allow")))
    return out.select("page_id", "host", "path", F.col("given.rule").alias("rule"), verdict.alias("verdict"))

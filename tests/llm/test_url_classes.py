"""Token classes of the URL miner: what always comes together is mined once, and no rule is lost."""

import random
from itertools import chain, combinations

from pyspark.sql import functions as F

from tidewatch.llm import url_rules


def test_shared_tokens_are_one(spark):
    """Thirty tokens that all labelled URLs share are one item, where plain mining lists 2^30 sets."""
    many = [f"t{i}" for i in range(30)]
    rows = [([*many, "ad", "banner"], True)] * 9 + [([*many, "news"], False)] * 9 + [(["late"], None)]
    labelled = spark.createDataFrame(rows, "tokens array<string>, blocked boolean")
    classes = {r["token"]: r["name"] for r in url_rules.token_classes(labelled).collect()}
    assert classes["ad"] == classes["banner"] == "ad" and {classes[t] for t in many} == {"t0"}
    assert set(classes) == {*many, "ad", "banner"}  # no blocked row holds the others
    named = url_rules.in_classes(labelled.where("blocked is not null").withColumn("id", F.monotonically_increasing_id()), "id", url_rules.token_classes(labelled))
    rules = url_rules.mine_rules(named.select("tokens", "blocked")).collect()
    assert [r["tokens"] for r in rules] == [["ad"]]


def test_verdicts_match_all_sets(spark):
    """Every set of tokens is tried; URLs are blocked where one that is sure and frequent enough is in them."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(7)]
    urls, labels = [], []
    for i in range(160):
        parts = [w for w in words if rng.random() < 0.5]
        urls.append((i, "http://h.test/" + "/".join(parts) + ("/" + "x" * 30_000 if i == 3 else "")))
        bad = {"w1", "w2", "w3"} <= set(parts) or {"w0", "w5"} <= set(parts)
        labels.append((i, None if i % 9 == 0 else bad if rng.random() < 0.97 else not bad))
    pages = spark.createDataFrame([*urls, (500, None), (501, "no scheme")], "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in url_rules.url_verdicts(pages, (), spark.createDataFrame(labels, "page_id long, blocked boolean"), 0.05, 0.9).collect()}
    held = {i: frozenset(["http", "h", "test", *u.split("/")[3:]]) for i, u in urls}
    known = [(held[i], b) for i, b in labels if b is not None]
    sets = [frozenset(c) for c in chain.from_iterable(combinations(["http", *words], k) for k in range(1, 9))]
    sure = []
    for s in sets:
        n, b = sum(s <= h for h, _ in known), sum(s <= h and b for h, b in known)
        if b >= 0.05 * len(known) and b / n >= 0.9:
            sure.append(s)
    want = {i: "block" if any(s <= h for s in sure) else "allow" for i, h in held.items()}
    assert {i: v for i, v in got.items() if i < 500} == want and "block" in want.values() and got[500] == got[501] == "allow"


def test_a_rule_of_three_tokens_fires_on_the_given_pages(spark):
    """The page that a miner of one and two tokens allows is blocked by one rule of scheme, host and path."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    row = url_rules.url_verdicts(pages).where("page_id = 94").first()
    assert row["verdict"] == "block" and row["rule"] is None
    host, path = url_rules.url_parts(F.col("url"))
    base = pages.dropDuplicates(["url"]).select("page_id", "url", url_rules.url_tokens(F.col("url"), host, path).alias("tokens"), url_rules.given_rule(host, path, url_rules.RULES).alias("given"))
    rules = url_rules.mine_rules(base.where("given is not null").select("tokens", (F.col("given.verdict") == "block").alias("blocked")))
    mine = set(base.where("page_id = 94").first()["tokens"])
    fired = [r["tokens"] for r in rules.collect() if set(r["tokens"]) <= mine]
    assert fired and all(len(t) == 3 for t in fired)

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch import config
from tidewatch.operators import sampling
from tidewatch.operators.prefix import position_bucket, prefix_sums
from tidewatch.streaming.feed import running_totals


def token(i, seed=42):
    return hashlib.md5(f"{seed}:{i}".encode()).hexdigest()


# One class holds two thirds of the rows, one a single row.
SIZES = {"BENIGN": 4000, "DoS": 1500, "DDoS": 300, "Botnet": 180, "WebAttack": 19, "Infiltration": 1}


@pytest.fixture(scope="module")
def rows(spark):
    labels = [c for c, n in SIZES.items() for _ in range(n)]
    return spark.createDataFrame(list(enumerate(labels)), "id long, cls string").repartition(5).cache()


def ids(df):
    return {(r["cls"], r["id"]) for r in df.select("cls", "id").collect()}


def brute(quota):
    out, start = set(), 0
    for c, n in SIZES.items():
        members = sorted(range(start, start + n), key=lambda i: (token(i), i))
        out |= {(c, i) for i in members[: quota.get(c, 0)]}
        start += n
    return out


def test_truncated_quota(rows):
    total = sum(SIZES.values())
    want = {c: min(n, max(1, int(n * (1000 / total)))) for c, n in SIZES.items()}
    assert ids(sampling.stratified_sample(rows, 1000, "cls", ["id"], strata=6)) == brute(want)
    assert ids(sampling.stratified_sample(rows, 1000, "cls", ["id"])) == brute(want)


def test_rounded_quota_and_small_table(rows):
    total = sum(SIZES.values())
    want = {c: max(1, min(n, int(round(n * (777 / total))))) for c, n in SIZES.items()}
    assert ids(sampling.reference_sample(rows, 777, "cls", ["id"])) == brute(want)
    assert sampling.reference_sample(rows, 10**6, "cls", ["id"]).count() == total
    assert sampling.reference_sample(rows, 50, None, ["id"]).count() == 50


def test_split_is_exact_and_stratified(rows):
    out = sampling.train_test_split(rows, "cls", ["id"], strata=6)
    got = {(r["cls"], r["split"]): r["count"] for r in out.groupBy("cls", "split").count().collect()}
    assert out.count() == sum(SIZES.values())
    n = sum(v for v in SIZES.values() if v >= 2)
    assert sum(v for (c, s), v in got.items() if s == "test") == math.ceil(0.2 * n)
    assert got[("Infiltration", "train")] == 1 and ("Infiltration", "test") not in got
    for c, size in SIZES.items():
        if size >= 2:
            assert abs(got[(c, "test")] - 0.2 * size) < 1
    assert sampling.test_rows(149_996) == 30_000


def test_mixes(rows):
    got = sampling.mixed_sample(rows, 1000, 0.5, "cls", ["id"])
    assert got.where("cls = 'BENIGN'").count() == 500 and got.count() == 1000
    # Attacks run out: all 2000 of them, benign rows for the rest.
    assert sampling.mixed_sample(rows, 3000, 0.9, "cls", ["id"]).where("cls <> 'BENIGN'").count() == 2000
    mixed = {r["cls"]: r["count"] for r in sampling.class_mix_sample(rows, 1000, 0.4, "cls", ["id"]).groupBy("cls").count().collect()}
    have = {c: w for c, w in config.ATTACK_MIX.items() if c in SIZES}
    total = sum(have.values())
    want = {c: min(SIZES[c], int(round(400 * w / total))) for c, w in have.items()}
    want["BENIGN"] = 1000 - sum(want.values())
    assert mixed == {c: n for c, n in want.items() if n}


def test_uniform_and_shuffle(rows):
    everyone = sorted(range(sum(SIZES.values())), key=lambda i: (token(i), i))
    assert {i for _, i in ids(sampling.uniform_sample(rows, 123, ["id"]))} == set(everyone[:123])
    assert sampling.uniform_sample(rows, 10**6, ["id"]).count() == len(everyone)
    assert [r["id"] for r in sampling.seeded_shuffle(rows, ["id"]).collect()] == everyone
    assert ids(sampling.uniform_sample(rows, 50, ["id"], 1)) != ids(sampling.uniform_sample(rows, 50, ["id"], 2))


def test_no_wide_shuffle_in_sample(rows):
    plan = sampling.stratified_sample(rows.withColumn("wide", F.lit("x") ), 10, "cls", ["id"], strata=6)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in text and "CartesianProduct" not in text


@pytest.mark.parametrize("buckets", [1, 3, 64])
def test_prefix_sums_match_brute_force(spark, buckets):
    rng = np.random.default_rng(3)
    pos = np.unique(rng.integers(0, 5000, 900))
    group = np.where(rng.random(len(pos)) < 0.8, 0, rng.integers(1, 4, len(pos)))
    val = rng.integers(0, 9, len(pos))
    df = spark.createDataFrame(list(zip(group.tolist(), pos.tolist(), val.tolist())), "g int, p long, v long").repartition(7)
    placed = df.withColumn("_b", position_bucket(F.col("p"), F.lit(0), F.lit(5000), buckets))
    out = prefix_sums(placed, ["g"], "_b", ["p"], {"cum": "v"}, lead=("nxt", "p"), total_rows=4 * buckets).collect()
    assert len(out) == len(pos)
    got = {(r["g"], r["p"]): (r["cum"], r["nxt"]) for r in out}
    for g in set(group.tolist()):
        at = [(p, v) for p, v, x in zip(pos.tolist(), val.tolist(), group.tolist()) if x == g]
        for k, (p, _) in enumerate(at):
            assert got[g, p] == (sum(v for _, v in at[: k + 1]), at[k + 1][0] if k + 1 < len(at) else None)


def test_session_totals(spark):
    df = spark.createDataFrame(
        [(0, "BENIGN", False, "BENIGN"), (1, "DDoS", True, "DDoS"), (2, "PortScan", True, "DoS"), (3, "BENIGN", False, None)],
        "i long, prediction string, is_attack boolean, truth string")
    last = running_totals(df, "i", parts=2).orderBy("i").collect()[-1]
    assert (last["flows"], last["attacks"], last["labelled"], last["accuracy"]) == (4, 2, 3, 2 / 3)

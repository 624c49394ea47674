from itertools import combinations

import numpy as np
import pytest

from tidewatch.operators import drift
from tidewatch.operators.drift import detect_drift, feature_distances, ks_pvalue, two_sample_ecdf


def frame(spark, x):
    return spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"feature_{i} double" for i in range(x.shape[1]))).repartition(4)


def pair(spark, n, shifted=0, shift=0.0, scale=1.0, width=10):
    rng = np.random.default_rng(n + shifted)
    ref, cur = rng.normal(size=(n, width)), rng.normal(size=(n, width))
    cur[:, :shifted] = rng.normal(shift, scale, (n, shifted))
    return frame(spark, ref), frame(spark, cur)


def verdict(result):
    return result["verdict"].first()


def test_no_false_alarm(spark):
    assert not verdict(detect_drift(*pair(spark, 5000)))["drift_detected"]


def test_one_and_half(spark):
    one = verdict(detect_drift(*pair(spark, 5000, 1, 3.0)))
    assert one["drift_share"] == 0.1 and not one["drift_detected"]
    half = verdict(detect_drift(*pair(spark, 5000, 5, 3.0)))
    assert half["drift_share"] == 0.5 and half["drift_detected"]


def test_variance_change_and_ranking(spark):
    assert verdict(detect_drift(*pair(spark, 5000, 10, 0.0, 5.0)))["n_drifted_features"] == 10
    ref, cur = pair(spark, 4000, 10, 2.0)
    cur = cur.withColumn("feature_3", cur["feature_3"] + 4.0)
    assert detect_drift(ref, cur)["top"].first()["feature"] == "feature_3"


def test_choice_of_test(spark):
    small = detect_drift(*pair(spark, 200, width=2))["per_feature"].collect()
    assert {r["test"] for r in small} == {"ks"}
    forced = detect_drift(*pair(spark, 200, width=2), stattest="anything")["per_feature"].collect()
    assert {r["test"] for r in forced} == {"wasserstein"}
    ref = spark.createDataFrame([(1.0,), (None,)], "a double")
    none = detect_drift(ref, ref)["per_feature"].first()
    assert none["test"] == "none" and none["score"] is None and not none["drifted"]


def test_constant_and_scale_free(spark):
    zeros = spark.createDataFrame([(0.0,)] * 3000, "a double")
    got = detect_drift(zeros, zeros)["per_feature"].first()
    assert got["score"] == 0.0 and not got["drifted"]
    moved = detect_drift(zeros, zeros.selectExpr("a + 1 AS a"))["per_feature"].first()
    assert moved["score"] == float("inf") and moved["drifted"]
    ref, cur = pair(spark, 3000, 1, 1.0, width=1)
    a = detect_drift(ref, cur)["per_feature"].first()["score"]
    b = detect_drift(ref.selectExpr("feature_0 * 1000 AS feature_0"), cur.selectExpr("feature_0 * 1000 AS feature_0"))["per_feature"].first()["score"]
    assert a == pytest.approx(b, rel=1e-9)


def test_no_shared_columns(spark):
    with pytest.raises(ValueError):
        detect_drift(spark.createDataFrame([(1.0,)], "a double"), spark.createDataFrame([(1.0,)], "b double"))


@pytest.mark.parametrize("parts", [1, 8, 64])
def test_distances_match_numpy_with_a_hot_value(spark, parts):
    """A third of each side is one value, and there are NaN and Inf cells."""
    rng = np.random.default_rng(11)
    a = np.where(rng.random(3000) < 0.35, 2.0, rng.normal(size=3000))
    b = np.where(rng.random(2000) < 0.35, 2.0, rng.normal(0.4, 1.3, size=2000))
    dirty = np.concatenate([b, [np.nan, np.inf, -np.inf]])
    ref, cur = frame(spark, a[:, None]), frame(spark, dirty[:, None])
    got = feature_distances(ref, cur, ["feature_0"], parts).first()
    grid = np.unique(np.concatenate([a, b]))
    f = np.searchsorted(np.sort(a), grid, side="right") / len(a)
    g = np.searchsorted(np.sort(b), grid, side="right") / len(b)
    assert got["statistic"] == pytest.approx(np.abs(f - g).max(), abs=1e-12)
    assert got["raw_distance"] == pytest.approx(np.sum(np.abs(f - g)[:-1] * np.diff(grid)), rel=1e-9)
    assert got["spread"] == pytest.approx(a.std(), rel=1e-9) and (got["n_ref"], got["n_cur"]) == (3000, 2000)
    assert two_sample_ecdf(ref, cur, ["feature_0"], parts).count() == len(grid)


@pytest.mark.parametrize("n,m", [(3, 3), (4, 6), (5, 7), (6, 4), (2, 9)])
def test_ks_pvalue_by_enumeration(n, m):
    """Every way to merge two samples is equally likely."""
    stats = []
    for picked in combinations(range(n + m), n):
        own, i, j, top = set(picked), 0, 0, 0
        for k in range(n + m):
            i, j = (i + 1, j) if k in own else (i, j + 1)
            top = max(top, abs(i * m - j * n))
        stats.append(top)
    for s in set(stats):
        want = np.mean([x >= s for x in stats])
        assert ks_pvalue(s / (n * m), n, m) == pytest.approx(want, abs=1e-12)


def test_ks_pvalue_textbook_values():
    assert ks_pvalue(1.0, 5, 5) == pytest.approx(2 / 252)
    # 5% critical values of the one-sample statistic.
    for n, d in ((10, 0.40925), (20, 0.29408), (50, 0.18841), (100, 0.13403)):
        assert drift._one_sample(d, n) == pytest.approx(0.05, abs=2e-4)
    assert drift._one_sample(1.3581 / np.sqrt(4_000_000), 4_000_000) == pytest.approx(0.05, abs=1e-3)
    assert ks_pvalue(0.0, 10, 10) == 1.0
    # Exact and limiting forms agree where they meet.
    assert ks_pvalue(0.02, 9_999, 9_999) == pytest.approx(ks_pvalue(0.02, 10_001, 10_001), rel=0.05)


def test_each_side_is_read_once(spark):
    """Sizes, spread, statistic and distance come from one scan of a side; a kept reference is not read again."""
    seen = spark.sparkContext.accumulator(0)

    def counted(df):
        def run(parts):
            for part in parts:
                seen.add(len(part))
                yield part

        return df.mapInPandas(run, df.schema)

    ref, cur = pair(spark, 500, 1, 1.0, width=3)
    want = feature_distances(ref, cur, ref.columns).collect()
    kept = drift.value_histogram(counted(ref), ref.columns)
    assert seen.value == 500
    assert feature_distances(kept, counted(cur), ref.columns).collect() == want
    assert seen.value == 1000
    assert [r["feature"] for r in feature_distances(kept, cur, ["feature_2", "feature_0"]).orderBy("pos").collect()] == ["feature_2", "feature_0"]


def test_large_and_small_laws_meet(spark):
    """The expression for large samples gives what the function for single features gives."""
    from pyspark.sql import functions as F

    rows = [(d, n, m) for d in (0.0, 0.001, 0.01, 0.02, 0.05, 0.4, 1.0) for n, m in ((20_000, 30_000), (10_001, 4_000), (400, 300), (5, 50_000))]
    got = spark.createDataFrame(rows, "d double, n long, m long").select("*", drift.ks_pvalues(F.col("d"), F.col("n"), F.col("m")).alias("p")).collect()
    for r in got:
        assert r["p"] == pytest.approx(ks_pvalue(r["d"], r["n"], r["m"]), rel=1e-9, abs=1e-12)

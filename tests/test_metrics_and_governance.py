import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch import config
from tidewatch.operators import governance, metrics
from tidewatch.plans.training import SWEEP
from tidewatch.sources import flows as sources
from tidewatch.sources import sinks

# Published figures of the six swept models: F1, mean attack miss rate, worst miss rate.
PUBLISHED = [
    ("rf_baseline", 0.840274, 0.051143, 0.285714), ("xgb_baseline", 0.930773, 0.02951, 0.142857),
    ("xgb_deep", 0.941447, 0.030437, 0.142857), ("mlp_baseline", 0.770114, 0.329547, 1.0),
    ("xgb_top40", 0.912725, 0.029783, 0.142857), ("xgb_top40_tuned", 0.933406, 0.030109, 0.142857),
]


def scored(spark, n=500, seed=0, drop=None):
    rng = np.random.default_rng(seed)
    truth = rng.choice(8, n, p=[0.60, 0.15, 0.10, 0.05, 0.04, 0.03, 0.02, 0.01])
    pred = np.where(rng.random(n) < 0.8, truth, rng.integers(0, 8, n))
    keep = truth != drop if drop is not None else np.ones(n, bool)
    t, p = truth[keep], pred[keep]
    df = spark.createDataFrame([(config.CLASSES[a], config.CLASSES[b]) for a, b in zip(t.tolist(), p.tolist())], "truth string, prediction string")
    return df, t, p


def brute(t, p):
    cm = np.zeros((8, 8), int)
    np.add.at(cm, (t, p), 1)
    tp, sup, hit = np.diag(cm), cm.sum(1), cm.sum(0)
    safe = lambda a, b: np.divide(a, b, out=np.zeros(8), where=b > 0)
    pr, rc = safe(tp, hit), safe(tp, sup)
    f1 = safe(2 * pr * rc, pr + rc)
    return cm, sup, hit, pr, rc, f1


@pytest.mark.parametrize("drop", [None, 7])
def test_metrics_match_brute_force(spark, drop):
    df, t, p = scored(spark, drop=drop)
    out = metrics.evaluate(df)
    cm, sup, hit, pr, rc, f1 = brute(t, p)
    cells = out["confusion"].collect()
    assert len(cells) == 64 and sum(r["n"] for r in cells) == len(t)
    assert all(cm[r["truth_id"], r["prediction_id"]] == r["n"] for r in cells)
    per = {r["class_id"]: r for r in out["per_class"].collect()}
    for k in range(8):
        r = per[k]
        assert r["insufficient_test_support"] == (sup[k] == 0)
        if sup[k]:
            assert r["recall"] == pytest.approx(rc[k]) and r["fnr"] + r["recall"] == pytest.approx(1.0)
            assert r["tp"] + r["fn"] + r["fp"] + r["tn"] == len(t)
        else:
            assert r["recall"] is None and r["fnr"] is None and r["fp"] == hit[k]
    s = out["summary"].first()
    seen = (sup + hit) > 0
    attack = [k for k in range(1, 8) if sup[k]]
    assert s["accuracy"] == pytest.approx((t == p).mean())
    assert s["macro_f1"] == pytest.approx(f1[seen].mean()) and s["macro_precision"] == pytest.approx(np.where(sup > 0, pr, 0)[seen].mean())
    assert s["weighted_f1"] == pytest.approx((f1 * sup).sum() / sup.sum())
    assert s["mean_attack_fnr"] == pytest.approx((1 - rc[attack]).mean())
    assert s["macro_attack_f1"] == pytest.approx(f1[attack].mean())
    assert s["mean_minority_f1"] == pytest.approx(f1[attack].mean())


def test_only_benign_has_zero_attack_metrics(spark):
    df = spark.createDataFrame([("BENIGN", "BENIGN")] * 3, "truth string, prediction string")
    s = metrics.evaluate(df)["summary"].first()
    assert (s["accuracy"], s["mean_attack_fnr"], s["macro_attack_f1"], s["mean_minority_fnr"]) == (1.0, 0.0, 0.0, 0.0)


def test_rows_without_truth_are_left_out(spark):
    df = spark.createDataFrame([("DoS", "DoS"), (None, "DoS")], "truth string, prediction string")
    assert metrics.evaluate(df)["summary"].first()["test_samples"] == 1


def summaries(spark, rows):
    return spark.createDataFrame(rows, "model string, ord long, macro_f1 double, mean_attack_fnr double, macro_attack_f1 double")


def test_leaderboard(spark):
    df = summaries(spark, [("a", 0, 0.9, 0.05, 0.8), ("b", 1, 0.95, 0.10, 0.9), ("c", 2, 0.95, 0.02, 0.7), ("d", 3, 0.95, 0.02, 0.9)])
    assert [r["model"] for r in metrics.leaderboard(df).orderBy("rank").collect()] == ["d", "c", "b", "a"]
    assert metrics.recommend(df).first()["provisional_champion"] == "d"
    assert metrics.recommend(df.limit(0)).first()["provisional_champion"] is None
    ranks = {r["model"]: r for r in metrics.metric_rankings(df).collect()}
    assert ranks["b"]["by_macro_f1"] == 1 and ranks["c"]["by_lowest_attack_fnr"] == 1


def challenger(spark, f1, fnr, per_class=None, old=None, zero=()):
    per_class = per_class or {"DoS": 0.01, "DDoS": 0.01}
    rows = [("m", 0, "BENIGN", 1000, 0.01)]
    rows += [("m", config.CLASS_IDS[c], c, 100, v) for c, v in per_class.items()]
    rows += [("m", config.CLASS_IDS[c], c, 0, None) for c in zero]
    classes = spark.createDataFrame(rows, "model string, class_id int, label_class string, support long, fnr double")
    summary = spark.createDataFrame([("m", 0.99, f1, fnr, f1)], "model string, accuracy double, macro_f1 double, mean_attack_fnr double, macro_attack_f1 double")
    gates = governance.gate_metrics(classes, summary)
    name, a, b = ("old", *old) if old else (None, None, None)
    row = gates.select("*", F.lit(name).cast("string").alias("champion"), F.lit(a).cast("double").alias("champion_macro_f1"), F.lit(b).cast("double").alias("champion_attack_fnr"))
    return governance.decide(row).first()


@pytest.mark.parametrize("args,kw,want", [
    ((0.70, 0.05), {}, True), ((0.90, 0.50), {}, False), ((0.95, 0.03), {"old": (0.90, 0.05)}, True),
    ((0.9005, 0.04), {"old": (0.90, 0.05)}, False), ((0.99, 0.06), {"old": (0.90, 0.02)}, False),
    ((0.95, 0.02), {"old": (0.90, 0.02)}, True), ((0.99, 0.05), {"old": (0.5, 0.09), "per_class": {"DoS": 0.01, "Botnet": 0.85}}, False),
    ((0.90, 0.03), {"zero": ("Infiltration",)}, True), ((0.90, 0.10), {"per_class": {"DoS": 0.30}}, True),
])
def test_gates(spark, args, kw, want):
    got = challenger(spark, *args, **kw)
    assert got["promoted"] == want and got["decision"] == ("PROMOTED" if want else "REJECTED")
    failed = [g for g in got["gates"] if not g["passed"]]
    assert len(got["reasons"]) == (len(got["gates"]) + 1 if want else len(failed) + 1)
    if "zero" in kw:
        assert got["classes_without_test_support"] == ["Infiltration"]


def test_gate_texts_and_worst_class(spark):
    got = challenger(spark, 0.9414, 0.0304, {"DoS": 0.05, "Botnet": 0.42, "WebAttack": 0.42}, (0.9308, 0.0295))
    texts = {g["gate"]: g["detail"] for g in got["gates"]}
    assert got["worst_attack_class"] == "Botnet" and got["worst_attack_fnr"] == 0.42
    assert texts["absolute_mean_attack_fnr"] == "mean attack FNR 0.0304 <= ceiling 0.1000"
    assert texts["absolute_per_class_fnr"] == "per-class FNR ceiling breached by Botnet (0.4200), WebAttack (0.4200)"
    assert texts["macro_f1_improvement"] == "macro F1 0.9414 vs champion 0.9308 (required >= 0.9318, margin 0.001)"
    assert got["reasons"][0] == "Rejected: 2 of 4 governance gates failed."


def test_published_sweep_gives_the_published_outcome(spark, tmp_path):
    rows = [(i, *r) for i, r in enumerate(PUBLISHED)]
    models = spark.createDataFrame(rows, "ord long, model string, macro_f1 double, mean_attack_fnr double, worst_attack_fnr double")
    log = governance.replay(models)
    got = [tuple(r) for r in log.orderBy("ord").collect()]
    assert got == [
        (0, "rf_baseline", None, True), (1, "xgb_baseline", "rf_baseline", True), (2, "xgb_deep", "xgb_baseline", False),
        (3, "mlp_baseline", "xgb_baseline", False), (4, "xgb_top40", "xgb_baseline", False), (5, "xgb_top40_tuned", "xgb_baseline", False),
    ]
    assert [c["name"] for c in SWEEP] == [r[0] for r in PUBLISHED]
    stored = log.withColumnRenamed("ord", "seq").withColumn("thresholds", F.struct(F.lit(0.001).alias("min_f1_improvement"), F.lit(0.1).alias("max_mean_fnr"), F.lit(0.3).alias("max_per_class_fnr")))
    path = str(tmp_path / "log")
    for part in ("seq < 3", "seq >= 3"):
        sinks.append_decision(stored.where(part), path)
    back = sources.read_decisions(spark, path)
    s = governance.history_summary(back).first()
    assert (s["total_decisions"], s["promotions"], s["rejections"], s["current_champion"]) == (6, 2, 4, "xgb_baseline")
    assert governance.current_champion(back).first()["challenger"] == "xgb_baseline"
    seen = governance.incumbents(back).collect()
    assert all(r["incumbent"] == r["champion"] for r in seen)
    assert governance.current_champion(back.where("NOT promoted")).count() == 0

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch import config
from tidewatch.functions.verdict import rationale
from tidewatch.operators import attribution, scoring
from tidewatch.operators.scaling import Parameters, apply_scaler, fit_fills, fit_scaler
from tidewatch.plans import analysis, training
from tidewatch.sources import flows as sources
from tidewatch.sources import sinks

FEATS = ["Flow Bytes/s", "Idle.Mean", "plain"]
THREE = {"BENIGN": 0, "DoS": 1, "DDoS": 2}


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(600):
        k = 0 if i % 3 else 1 + i % 2
        x = rng.normal(loc=[k * 5.0, -3.0 * k, 0.0], size=3)
        rows.append((i, k, list(THREE)[k], *map(float, x)))
    return spark.createDataFrame(rows, "flow_id long, label_int int, label_class string, a double, b double, p double").toDF(
        "flow_id", "label_int", "label_class", *FEATS).repartition(4).cache()


@pytest.fixture(scope="module")
def fitted(table):
    return {
        "forest": training.fit_forest(table, FEATS, classes=3, trees=7, depth=4),
        "boosted": training.fit_boosted(table, FEATS, classes=3, rounds=3, depth=2),
        "network": training.fit_network(table, FEATS, classes=3, hidden=[5], epochs=20),
    }


@pytest.mark.parametrize("kind", ["forest", "boosted", "network"])
def test_models_score(table, fitted, kind):
    out = training.score(table, fitted[kind], FEATS, list(THREE)).collect()
    assert all(abs(sum(r["probs"]) - 1) < 1e-6 and len(r["probs"]) == 3 for r in out)
    assert np.mean([r["prediction"] == r["label_class"] for r in out]) > 0.75
    assert all(r["confidence"] == max(r["probs"]) and r["is_attack"] == (r["prediction"] != "BENIGN") for r in out)
    padded = training.score(table.limit(2), fitted[kind], FEATS).first()
    assert len(padded["probs"]) == 8 and padded["probs"][3:] == [0.0] * 5


def walked(nodes, x, classes):
    """Base and credits per class and feature, tree by tree and step by step."""
    trees = {}
    for n in nodes:
        trees.setdefault(n["tree"], {})[n["id"]] = n
    base, credit = np.zeros(classes), np.zeros((classes, len(x)))
    for tree in trees.values():
        at = tree[0]
        base += at["value"]
        while at["left"] >= 0:
            go = tree[at["left"] if x[at["feature"]] <= at["threshold"] else at["right"]]
            credit[:, at["feature"]] += np.array(go["value"]) - np.array(at["value"])
            at = go
    return base, credit


@pytest.mark.parametrize("kind,limit", [("forest", 1 << 27), ("forest", 0), ("boosted", 1 << 27), ("boosted", 0), ("binary", 1 << 27)])
def test_contributions_match_a_walk(spark, table, fitted, kind, limit):
    """The leaf table gives what a walk through every tree gives, by broadcast or by a join, and adds up to the raw score."""
    model, names = fitted["boosted" if kind == "binary" else kind], list(THREE)
    classes = 1 if kind == "binary" else 3
    if kind == "binary":
        model = model.models[1]
    scored = table.withColumn("predicted_id", F.lit(0)) if kind == "binary" else training.score(table, model, FEATS, names).withColumn(
        "predicted_id", F.array_position(F.array(*[F.lit(n) for n in names]), F.col("prediction")) - 1)
    parts = attribution.tree_contributions(scored, model, FEATS, "flow_id", classes, broadcast_bytes=limit)
    nodes = []
    for k, member in enumerate(attribution._members(model)):
        path = attribution.shared_dir(spark, "test-trees")
        member.write().save(path)
        cuts = {(r["treeID"], r["nodeData"]["id"]): r["nodeData"]["split"]["leftCategoriesOrThreshold"] for r in spark.read.parquet(f"{path}/data").collect()}
        for r in attribution.node_table(spark, member, 1 if kind != "forest" else 3).collect():
            value = r["value"] if kind == "forest" else [r["value"][0] if i == k % classes else 0.0 for i in range(classes)]
            nodes.append(r.asDict() | {"tree": (k, r["tree"]), "value": value, "threshold": (cuts[r["tree"], r["id"]] or [0.0])[0]})
    got = {r["flow_id"]: r for r in parts.collect()}
    rows = scored.orderBy("flow_id").collect()
    assert len(got) == len(rows)
    for r in rows[:40]:
        k, x = r["predicted_id"], [r[f] for f in FEATS]
        base, credit = walked(nodes, x, classes)
        g = got[r["flow_id"]]
        assert g["base"] == pytest.approx(base[k], abs=1e-9)
        assert g["contribution"] == pytest.approx(list(credit[k]), abs=1e-9)
        assert g["all_abs"] == pytest.approx(list(np.abs(credit).sum(0)), abs=1e-9)
        if kind == "forest":
            assert g["base"] + sum(g["contribution"]) == pytest.approx(r["confidence"], abs=1e-9)
    if kind != "forest":
        raw = (model if kind == "binary" else model.models[1]).transform(training.assemble(table, FEATS)).orderBy("flow_id").collect()
        k = 0 if kind == "binary" else 1
        mine = [(r["rawPrediction"][1], sum(got[r["flow_id"]]["contribution"]) + got[r["flow_id"]]["base"]) for r, s in zip(raw, rows) if s["predicted_id"] == k]
        assert mine and all(a == pytest.approx(b, abs=1e-9) for a, b in mine)
    means = {r["feature"]: r["mean_abs"] for r in attribution.global_importance(parts, FEATS, classes).collect()}
    assert means == pytest.approx({f: float(np.mean([g["all_abs"][i] for g in got.values()])) / classes for i, f in enumerate(FEATS)})


def test_deep_and_single_node_trees(spark):
    """A path of nine splits, known after four doublings, and a tree that is one leaf."""
    rows = []
    for d in range(9):  # pre-order: the left child is a leaf, the right one goes on
        rows.append((0, 2 * d, 2 * d + 1, 2 * d + 2, d % 2, [float(d), 0.0]))
        rows.append((0, 2 * d + 1, -1, -1, -1, [10.0 * d, 1.0]))
    rows += [(0, 18, -1, -1, -1, [9.0, 0.0]), (1, 0, -1, -1, -1, [0.5, 0.5])]
    nodes = spark.createDataFrame(rows, "tree int, id int, left int, right int, feature int, value array<double>")
    got = {(r["tree"], r["leaf"]): {s["f"]: s["d"] for s in r["steps"]} for r in attribution.leaf_table(nodes, 3).collect()}
    assert len(got) == 10 and got[0, 9] == {0: [5.0, 0.0], 1: [4.0, 0.0], 2: [0.0, 0.0]}
    assert got[0, 3] == {0: [2.0, 0.0], 1: [28.0, 1.0], 2: [0.0, 0.0]}
    assert (1, 0) not in got  # a leaf without credits adds nothing
    assert attribution.base_scores(nodes) == [0.5, 0.5]


def test_ranking_and_sets(spark, fitted):
    scores = training.importances(fitted["boosted"])
    assert len(scores) == 3 and abs(sum(training.importances(fitted["forest"])) - 1) < 1e-9
    ranked = training.rank_features(spark, FEATS, [0.2, 0.5, 0.2]).orderBy("rank").collect()
    assert [r["feature"] for r in ranked] == ["Idle.Mean", "Flow Bytes/s", "plain"]
    sets = training.feature_sets([f"f{i}" for i in range(35)], list(range(35)), [f"f{i}" for i in range(50)])
    assert [len(v) for v in sets.values()] == [20, 30, 35, 50] and sets["Top-20 Features"][0] == "f34"


def test_experiment_and_sweep(table):
    out = training.feature_experiment(table, table, {"all": FEATS, "noise": ["plain"]}, THREE, trees=5, depth=3).collect()
    assert out[0]["feature_set"] == "all" and {r["feature_count"] for r in out} == {1, 3}
    configs = [
        {"name": "noise", "kind": "random_forest", "features": "top1", "args": {"trees": 2, "depth": 2}},
        {"name": "good", "kind": "random_forest", "features": "full", "args": {"trees": 7, "depth": 5}},
    ]
    runs = training.sweep(table, table, FEATS, THREE, configs, ranking=[0.0, 0.0, 1.0], incumbent=None)
    assert [r["decision"]["decision"] for r in runs] == ["REJECTED", "PROMOTED"] and runs[0]["features"] == ["plain"]
    with pytest.raises(KeyError):
        training.sweep(table, table, FEATS, THREE, [{"name": "x", "kind": "other", "features": "full", "args": {}}])


def test_serving_set_round_trip(spark, fitted, table, tmp_path):
    from pyspark.ml.classification import RandomForestClassificationModel

    params = Parameters(FEATS, dict.fromkeys(FEATS, 0.0), dict.fromkeys(FEATS, 0.0), dict.fromkeys(FEATS, 1.0))
    meta = spark.createDataFrame([("m", 3)], "model string, feature_count int")
    sinks.write_serving_set(spark, fitted["forest"], params, meta, None, str(tmp_path / "s"))
    model = RandomForestClassificationModel.load(str(tmp_path / "s/model"))
    again = sources.read_parameters(spark, str(tmp_path / "s/parameters"), FEATS)
    a = training.score(table, fitted["forest"], FEATS, list(THREE)).agg(F.sum("confidence")).first()[0]
    b = training.score(table, model, again.features, list(THREE)).agg(F.sum("confidence")).first()[0]
    assert a == pytest.approx(b)


def test_analysis_is_the_same_for_every_format(spark, table, tmp_path):
    fills = fit_fills(table, FEATS)
    center, scale = fit_scaler(table, FEATS)
    params = Parameters(FEATS, fills, center, scale)
    model = training.fit_forest(apply_scaler(table, params), FEATS, classes=3, trees=5, depth=4)
    rows = [
        {"flow_id": r["flow_id"], "FLOW_BYTES-S": r["Flow Bytes/s"], "idle mean": r["Idle.Mean"], "Plain": r["plain"], "Label": r["label_class"], "extra": 1}
        for r in table.orderBy("flow_id").limit(120).collect()
    ]
    (tmp_path / "x.csv").write_text("\n".join(";".join(map(str, r)) for r in [list(rows[0]), *[list(r.values()) for r in rows]]))
    (tmp_path / "x.json").write_text(json.dumps({"records": rows}))
    (tmp_path / "x.jsonl").write_text("\n".join(map(json.dumps, rows)))
    spark.createDataFrame(rows).write.parquet(str(tmp_path / "x.parquet"))
    seen = []
    for n in ("x.csv", "x.json", "x.jsonl", "x.parquet"):
        export = sources.read_export(spark, str(tmp_path / n))
        export = export.withColumn("flow_id", F.col("flow_id").cast("long"))
        every = analysis.analyze(export, model, params, classes=THREE)
        assert every["rows"].where("top_features is null").count() == 0 and not every["summary"].first()["truncated"]
        out = analysis.analyze(export, model, params, classes=THREE, returned=100, explained=50)
        s = out["summary"].first()
        assert s["total_connections"] == 120 and s["total_attacks"] + s["total_benign"] == 120 and s["truncated"]
        assert out["unused_columns"] == ["extra"] and out["coverage"]["coverage"] == 1.0
        assert sum(r["n"] for r in out["class_breakdown"].collect()) == 120
        assert sum(r["count"] for r in out["confidence_histogram"].collect()) == 120
        acc = out["truth_accuracy"].first()
        assert acc["scored"] == 120 and acc["accuracy"] > 0.8
        listing = out["rows"].orderBy("flow_id").collect()
        assert len(listing) == 100 and len(listing[0]["top_features"]) == 3 and listing[99]["top_features"] is None
        tops = out["top_suspicious"].collect()
        assert len(tops) <= 10 and all(r["is_attack"] for r in tops)
        assert [r["rank"] for r in out["global_attribution"].orderBy("rank").collect()] == [1, 2, 3]
        seen.append([(r["flow_id"], r["prediction"], r["confidence"]) for r in listing])
    assert all(x == seen[0] for x in seen)


def test_unrelated_file_is_refused(spark, fitted):
    params = Parameters(FEATS, dict.fromkeys(FEATS, 0.0), dict.fromkeys(FEATS, 0.0), dict.fromkeys(FEATS, 1.0))
    bad = spark.createDataFrame([(1, "x", "y")], "flow_id long, name string, city string")
    with pytest.raises(ValueError, match="limit"):
        analysis.analyze(bad, fitted["forest"], params, classes=THREE)
    with pytest.raises(ValueError, match="no data rows"):
        analysis.analyze(bad.limit(0), fitted["forest"], params, classes=THREE)


def verdicts(spark, rows):
    return spark.createDataFrame(rows, "id long, truth string, prediction string, confidence double").withColumn("is_attack", F.col("prediction") != "BENIGN")


def test_representatives_flag_classes_never_right(spark):
    df = verdicts(spark, [
        (1, "BENIGN", "BENIGN", 0.7), (2, "BENIGN", "BENIGN", 0.9), (3, "BENIGN", "DoS", 0.99), (4, "DoS", "DoS", 0.5),
        (5, "DoS", "BENIGN", 0.95), (6, "Botnet", "DoS", 0.8), (7, "Botnet", "BENIGN", 0.6), (8, None, "DoS", 1.0)])
    got = {(r["truth"], r["id"]): r["correctly_classified"] for r in scoring.representatives(df, "id").collect()}
    assert got == {("BENIGN", 2): True, ("BENIGN", 1): True, ("DoS", 4): True, ("Botnet", 6): False}


def test_histogram_edges_and_profile(spark):
    df = verdicts(spark, [(i, None, "DoS", x) for i, x in enumerate([0.0, 0.5, 0.59, 0.9, 1.0])])
    assert [r["count"] for r in scoring.confidence_histogram(df).orderBy("bin").collect()] == [1, 2, 0, 0, 0, 2]
    empty = scoring.dataset_profile(df).first()
    assert empty["total_flows"] == 5 and not empty["labelled"] and empty["attack_rate"] is None
    assert scoring.accuracy(df).first()["accuracy"] is None


def test_flagged_file_quotes_everything(spark, tmp_path):
    feature = "array<struct<feature:string,value:double,increases_threat:boolean>>"
    df = spark.createDataFrame([(1, 'D"oS', 0.91239, True, [("a", 1.5, True), ("b", 2.0, False)]), (2, "BENIGN", 0.9, False, [])],
                               f"flow_id long, prediction string, confidence double, is_attack boolean, top_features {feature}")
    sinks.write_flagged(df, str(tmp_path / "f"))
    text = "".join(p.read_text() for p in (tmp_path / "f").glob("part-*"))
    assert '"1","D""oS","0.9124","a=1.5; b=2.0"' in text and "BENIGN" not in text
    got = df.select(rationale(F.col("prediction"), F.col("confidence"), F.col("top_features")).alias("t")).collect()
    assert got[0]["t"] == 'Classified D"oS at 91.2% confidence, driven by a (1.5).' and got[1]["t"] is None


def test_contract_violations(spark):
    good = Parameters(["a"], {"a": 1.0}, {"a": 0.0}, {"a": 1.0}).to_df(spark)
    df = spark.createDataFrame([([0.5, 0.5], "DoS"), ([0.5, 0.4], "Other"), ([1 / 9] * 9, "DoS")], "probs array<double>, prediction string")
    got = {r["check"]: r["violations"] for r in scoring.contract_violations(df, good, ["a"]).collect()}
    assert got["probabilities_sum_to_one"] == 1 and got["prediction_in_taxonomy"] == 1 and got["probability_width"] == 1
    assert got["parameter_order"] == 0 and got["class_ids_unique"] == 0
    assert {r["check"]: r["violations"] for r in scoring.contract_violations(df, good, ["b"]).collect()}["parameter_order"] == 2


@pytest.mark.parametrize("limit", [0, 5, 1500, 2999, 3000, 5000])
def test_first_rows(spark, limit):
    """Whatever the type and the spread of the key: squares, text, a cluster with one far id, two columns with nulls."""
    ids = [i * i for i in range(3000)]
    df = spark.createDataFrame([(i,) for i in ids], "id long").repartition(7)
    assert [r["id"] for r in scoring.first_rows(df, "id", limit, parts=16).collect()] == ids[:limit]
    names = sorted(f"flow {i % 13} {i}" for i in range(3000))
    text = spark.createDataFrame([(n,) for n in names], "id string").repartition(7)
    assert [r["id"] for r in scoring.first_rows(text, "id", limit, parts=5).collect()] == names[:limit]
    if limit == 1500:
        far = [*range(2999), 2**62]
        df = spark.createDataFrame([(i,) for i in far], "id long").repartition(3)
        assert [r["id"] for r in scoring.first_rows(df, "id", limit).collect()] == far[:limit]
        pairs = [(None if i % 3 else "a", i) for i in range(3000)]
        df = spark.createDataFrame(pairs, "a string, b long").repartition(3)
        assert [tuple(r) for r in scoring.first_rows(df, ["a", "b"], limit).collect()] == sorted(pairs, key=lambda p: (p[0] or "", p[1]))[:limit]

import json

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from tidewatch.functions import names
from tidewatch.operators import cleaning, preparing, quality, quantiles, scaling
from tidewatch.operators.scaling import Parameters
from tidewatch.plans.preparation import FlowPreparer, prepare_training_tables, split_counts
from tidewatch.sources import flows as sources
from tidewatch.sources import sinks

NAN, INF = float("nan"), float("inf")


def test_inf_counts_and_replacement(spark):
    df = spark.createDataFrame([(1.0, -INF, 1), (INF, 2.0, 2), (3.0, 4.0, 3)], "a double, b double, c int")
    got = {r["feature"]: (r["pos_inf"], r["neg_inf"]) for r in quality.inf_counts(df, ["a", "b", "c"]).collect()}
    assert got == {"a": (1, 0), "b": (0, 1), "c": (0, 0)}
    out = quality.replace_inf(df, ["a", "b"])
    assert out.where("a IS NULL").count() == 1 and out.where("b IS NULL").count() == 1
    assert quality.cell_counts(df, ["a", "b"]).first() == (2, 0)


def test_fills(spark):
    train = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (None,)], "a double")
    test = spark.createDataFrame([(100.0,), (200.0,), (None,)], "a double")
    fills = scaling.fit_fills(train, ["a"])
    assert fills == {"a": 2.0}
    assert [r[0] for r in scaling.apply_fills(test, fills).collect()] == [100.0, 200.0, 2.0]
    assert scaling.fit_fills(spark.createDataFrame([(x,) for x in (1.0, 2.0, 3.0, 4.0, NAN)], "a double"), ["a"]) == {"a": 2.5}
    assert scaling.fit_fills(train, ["a"], "zero") == {"a": 0.0}
    with pytest.raises(ValueError):
        scaling.fit_fills(train, ["a"], "drop")


def test_constant_columns(spark):
    df = spark.createDataFrame([(1, 0, 4.0, 5.0), (2, 0, 5.0, 5.0), (3, 0, 6.0, INF)], "a int, const int, b double, odd double")
    found = lambda **k: [r["feature"] for r in quality.constant_columns(df, df.columns, **k).collect()]
    assert found() == ["const"] and found(inf_breaks=False) == ["const", "odd"]
    assert quality.constant_columns(df.limit(1), df.columns).count() == 0


def test_dedup_ignores_file_and_keeps_first(spark):
    rows = [(1, 3, "f2"), (2, 4, "f1"), (1, 3, "f1")]
    df = spark.createDataFrame(rows, "a int, b int, source_file string")
    out = {(r["a"], r["b"]): r["source_file"] for r in cleaning.deduplicate(df, manifest=["f1", "f2"]).collect()}
    assert out == {(1, 3): "f1", (2, 4): "f1"}
    with pytest.raises(Exception, match="outside the manifest"):
        cleaning.deduplicate(df, manifest=["f1"]).collect()
    nans = spark.createDataFrame([(NAN, "x"), (NAN, "y"), (0.0, "x"), (-0.0, "y")], "a double, source_file string")
    assert cleaning.deduplicate(nans, manifest=["x", "y"]).count() == 2


def test_clean_job(spark):
    df = spark.createDataFrame(
        [("Benign", 1.0, 0.0, "f"), ("Benign", 1.0, 0.0, "g"), (" DDoS", INF, 0.0, "f"), ("DDoS", NAN, 0.0, "f"), ("DDoS", 2.0, 0.0, "f")],
        "Label string, x double, zero double, source_file string")
    out, constant = cleaning.clean(df, manifest=["f", "g"])
    assert constant == ["zero"] and out.count() == 4  # the raw label text is part of the key
    assert set(out.columns) == {"label_raw", "label_class", "x", "source_file"}
    got = cleaning.cleaning_counts(df).first().asDict()
    assert (got["input_rows"], got["output_rows"], got["duplicates_dropped"], got["inf_replaced"]) == (5, 4, 1, 1)
    with pytest.raises(KeyError):
        cleaning.clean(df.drop("Label"))


def test_quantiles_match_numpy_with_a_hot_value(spark):
    rng = np.random.default_rng(7)
    n = 30_000
    hot = np.where(rng.random(n) < 0.4, 5.0, rng.lognormal(1, 2, n))
    ints = rng.integers(0, 7, n).astype(float)
    gaps = np.where(rng.random(n) < 0.2, np.nan, rng.normal(size=n))
    df = spark.createDataFrame(zip(hot.tolist(), ints.tolist(), gaps.tolist(), [None] * n), "hot double, ints double, gaps double, none double").repartition(6)
    probs = [0.0, 0.25, 0.5, 0.75, 0.999, 1.0]
    for limits in ({}, {"sketch": 200}, {"sketch": 5}):
        got = quantiles.quantiles(df, df.columns, probs, **limits)
        for name, x in (("hot", hot), ("ints", ints), ("gaps", gaps)):
            np.testing.assert_allclose(got[name], np.nanquantile(x, probs), rtol=1e-12)
        assert got["none"] == [None] * len(probs)


def test_two_scans_for_many_columns(spark):
    """78 columns and three probabilities: the table is read twice; correlations of all pairs read it once."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 78))
    names = [f"c{i}" for i in range(78)]
    table = spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"{n} double" for n in names))
    seen = spark.sparkContext.accumulator(0)
    read = table.mapInPandas(lambda parts: (_counted(part, seen) for part in parts), table.schema)
    got = quantiles.quantiles(read, names, [0.25, 0.5, 0.75])
    np.testing.assert_allclose([got[n] for n in names], np.quantile(x, [0.25, 0.5, 0.75], axis=0).T, rtol=1e-12)
    assert seen.value == 2 * 500
    pairs = {(r["i"], r["j"]): r["r"] for r in scaling.correlation_pairs(read, names).collect()}
    want = np.corrcoef(x.T)
    assert len(pairs) == 78 * 77 // 2 and all(abs(r - want[i, j]) < 1e-9 for (i, j), r in pairs.items())
    assert 3 * 500 <= seen.value <= 4 * 500  # and the few rows of the shift


def _counted(part, seen):
    seen.add(len(part))
    return part


def test_correlations_of_columns_with_gaps(spark):
    """Only rows where both are present count, at any offset; constants and single rows have no correlation."""
    rng = np.random.default_rng(8)
    n = 400
    base = rng.normal(size=n)
    cols = {"a": base, "b": base * 2 + rng.normal(size=n), "far": 1e9 + base + rng.normal(size=n), "flat": np.full(n, 0.1), "tiny": 1e-9 * rng.normal(size=n)}
    gap = {k: np.where(rng.random(n) < 0.3, np.nan, v) for k, v in cols.items()}
    gap["late"] = np.where(np.arange(n) < n - 5, np.nan, base + 1e6)
    gap["one"] = np.where(np.arange(n) == 7, 3.0, np.nan)
    gap["none"] = np.full(n, np.nan)
    names = list(gap)
    rows = [tuple(None if np.isnan(v) else float(v) for v in r) for r in zip(*gap.values())]
    df = spark.createDataFrame(rows, ", ".join(f"{x} double" for x in names)).coalesce(1)
    got = {(r["left"], r["right"]): r["r"] for r in scaling.correlation_pairs(df, names).collect()}
    for (x, y), r in got.items():
        both = ~np.isnan(gap[x]) & ~np.isnan(gap[y])
        if "flat" in (x, y) or both.sum() < 2:
            assert r is None
        else:
            assert r == pytest.approx(np.corrcoef(gap[x][both], gap[y][both])[0, 1], abs=1e-6)


def test_correlation_keeps_one_of_a_pair(spark):
    rng = np.random.default_rng(1)
    a = rng.normal(size=200)
    rows = list(zip(a.tolist(), (2 * a + rng.normal(scale=0.01, size=200)).tolist(), rng.normal(size=200).tolist(), [1.0] * 200))
    df = spark.createDataFrame(rows, "a double, b double, c double, k double")
    assert scaling.correlated_columns(df, df.columns) == ["b"]
    pairs = {(r["left"], r["right"]): r["r"] for r in scaling.correlation_pairs(df, df.columns).collect()}
    assert abs(pairs["a", "b"]) > 0.95 and pairs["a", "k"] is None
    # A dropped column still drops later ones that correlate with it.
    chain = spark.createDataFrame([(float(x), float(x), float(x)) for x in range(50)], "a double, b double, c double")
    assert scaling.correlated_columns(chain, ["a", "b", "c"]) == ["b", "c"]


def test_scalers(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (3.0, 5.0), (6.0, 5.0)], "a double, k double")
    assert scaling.fit_scaler(df, ["a", "k"], "robust") == ({"a": 2.5, "k": 5.0}, {"a": 2.0, "k": 1.0})
    center, scale = scaling.fit_scaler(df, ["a", "k"], "standard")
    assert center == {"a": 3.0, "k": 5.0} and scale["k"] == 1.0 and abs(scale["a"] - np.std([1, 2, 3, 6])) < 1e-12
    assert scaling.fit_scaler(df, ["a", "k"], "minmax") == ({"a": 1.0, "k": 5.0}, {"a": 5.0, "k": 1.0})
    with pytest.raises(ValueError):
        scaling.fit_scaler(df, ["a"], "other")


def test_parameter_slice_and_storage(spark, tmp_path):
    full = Parameters(["a", "b", "c"], {"a": 1.0, "b": 2.0, "c": 3.0}, {"a": 0.0, "b": 1.0, "c": 2.0}, {"a": 1.0, "b": 2.0, "c": 4.0})
    part = full.slice(["c", "a"])
    assert part.features == ["c", "a"] and part.scale == {"c": 4.0, "a": 1.0}
    with pytest.raises(ValueError):
        full.slice(["zz"])
    path = str(tmp_path / "params")
    sinks.write_parameters(spark, part, path)
    assert sources.read_parameters(spark, path, ["c", "a"]) == part
    with pytest.raises(ValueError):
        sources.read_parameters(spark, path, ["a", "c"])
    with pytest.raises(FileNotFoundError):
        sources.read_parameters(spark, str(tmp_path / "none"))
    rows = spark.createDataFrame([(4.0, 5.0, 6.0)], "a double, b double, c double")
    whole, cut = preparing.prepare(rows, full).first(), preparing.prepare(rows.select("c", "a"), part).first()
    assert (whole["a"], whole["c"]) == (cut["a"], cut["c"])


def test_prepare_policy(spark):
    p = Parameters(["a", "b", "c", "d"], dict.fromkeys("abcd", 9.0), dict.fromkeys("abcd", 1.0), dict.fromkeys("abcd", 2.0))
    three = spark.createDataFrame([("5", INF, None)], "A string, b double, c double")
    out = preparing.prepare(names.normalize_columns(three, p.features), p, normalized=True, allow_missing=True).first()
    assert out.asDict() == {"n_filled": 2, "a": 2.0, "b": 4.0, "c": 4.0, "d": 4.0}
    with pytest.raises(ValueError, match="lacks"):
        preparing.prepare(three, p)
    with pytest.raises(ValueError, match="limit"):
        preparing.prepare(spark.createDataFrame([(1.0, 2.0)], "a double, b double"), p, allow_missing=True)
    assert preparing.coverage(["a", "b", "x"], p.features)["coverage"] == 0.5
    bad = preparing.split_valid(spark.createDataFrame([(1.0, NAN, None, INF)], "a double, b double, c double, d double"), p.features).first()
    assert not bad["accepted"] and bad["rejected_features"] == ["b", "c", "d"]
    shown = preparing.display_values(spark.createDataFrame([("x", INF)], "a string, b double"), p).first()
    assert (shown["a"], shown["b"], shown["d"]) == (9.0, INF, 9.0)


def test_no_leak_and_integrity(spark):
    rows = [(i, float(i % 10), float(i % 10) * 3, None if i % 7 == 0 else float(i), "BENIGN" if i % 3 else "DoS") for i in range(300)]
    df = spark.createDataFrame(rows, "id int, a double, twin double, `x.y/z` double, label_class string")
    ready, model = prepare_training_tables(df, ["id"])
    assert model.dropped == ["twin"] and model.features == ["a", "x.y/z"]
    counts = {(r["split"], r["label_class"]): r["rows"] for r in split_counts(ready).collect()}
    assert counts == {("train", "BENIGN"): 160, ("test", "BENIGN"): 40, ("train", "DoS"): 80, ("test", "DoS"): 20}
    train_ids = {r["id"] for r in ready.where("split = 'train'").collect()}
    values = [r[3] for r in rows if r[0] in train_ids and r[3] is not None]
    assert abs(model.fills["x.y/z"] - float(np.median(values))) < 1e-9
    empty = spark.createDataFrame([(None,)], "a double")
    with pytest.raises(RuntimeError):
        FlowPreparer(["a"], correlation=None).fit(empty)
    with pytest.raises(RuntimeError):
        quality.check_no_missing(spark.createDataFrame([("test", None)], "split string, a double"), ["a"])


def test_weights(spark):
    df = spark.createDataFrame([("a",)] * 6 + [("b",)] * 2, "cls string")
    got = {r["cls"]: r["weight"] for r in scaling.class_weights(df, "cls").collect()}
    assert got == {"a": 8 / (2 * 6), "b": 8 / (2 * 2)}


# sources -------------------------------------------------------------------------

def test_manifest(spark, tmp_path):
    d = str(tmp_path)
    one = spark.createDataFrame([(1.0, "Benign")], "v double, l string").toDF(" Flow Duration", "Label ")
    one.write.parquet(f"{d}/a.parquet")
    one.write.parquet(f"{d}/b.parquet")
    one.write.parquet(f"{d}/extra.parquet")
    df, info = sources.read_manifest(spark, d, ["a.parquet", "b.parquet"])
    assert df.columns == ["Flow Duration", "Label", "source_file"] and info["ignored"] == ["extra.parquet"]
    assert sorted(r["source_file"] for r in df.collect()) == ["a.parquet", "b.parquet"]
    with pytest.raises(FileNotFoundError, match="c.parquet.*d.parquet"):
        sources.read_manifest(spark, d, ["a.parquet", "c.parquet", "d.parquet"])
    spark.createDataFrame([(1, "x")], "`Flow Duration` int, Label string").write.parquet(f"{d}/narrow.parquet")
    wide, _ = sources.read_manifest(spark, d, ["a.parquet", "narrow.parquet"])
    assert dict(wide.dtypes)["Flow Duration"] == "double" and wide.count() == 2
    spark.createDataFrame([("x", 1)], "Label string, `Flow Duration` int").write.parquet(f"{d}/order.parquet")
    with pytest.raises(ValueError, match="differ"):
        sources.read_manifest(spark, d, ["a.parquet", "order.parquet"])


def test_manifest_of_plain_files(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    for n in ("one file.parquet", "two.parquet"):
        pq.write_table(pa.table({"v": [1.0], "Label": ["Benign"]}), tmp_path / n)
    df, _ = sources.read_manifest(spark, str(tmp_path), ["one file.parquet", "two.parquet"])
    assert sorted(r["source_file"] for r in df.collect()) == ["one file.parquet", "two.parquet"]


ROWS = [{"Flow Duration": float(i), "Total Packets": float(i * 2), "Label": "Benign"} for i in range(12)]


@pytest.mark.parametrize("kind", ["csv", "tsv", "semicolon", "pipe", "array", "wrapped", "single", "jsonl", "parquet"])
def test_export_formats_agree(spark, tmp_path, kind):
    head = list(ROWS[0])
    rows = ROWS[:1] if kind == "single" else ROWS
    seps = {"csv": ",", "tsv": "\t", "semicolon": ";", "pipe": "|"}
    if kind in seps:
        p = tmp_path / "x.csv"
        p.write_text("\n".join(seps[kind].join(str(v) for v in r) for r in [head, *[list(r.values()) for r in rows]]))
    elif kind in ("array", "wrapped", "single"):
        p = tmp_path / "x.json"
        p.write_text(json.dumps({"array": rows, "wrapped": {"meta": 1, "flows": rows}, "single": rows[0]}[kind]))
    elif kind == "jsonl":
        p = tmp_path / "x.jsonl"
        p.write_text("\n".join(map(json.dumps, rows)))
    else:
        p = tmp_path / "x.parquet"
        spark.createDataFrame(rows).write.parquet(str(p))
    params = Parameters(head[:2], dict.fromkeys(head[:2], 0.0), dict.fromkeys(head[:2], 1.0), dict.fromkeys(head[:2], 2.0))
    out = preparing.prepare(sources.read_export(spark, str(p)), params).orderBy("Flow Duration").collect()
    assert [tuple(r)[1:] for r in out] == [((r[head[0]] - 1) / 2, (r[head[1]] - 1) / 2) for r in rows]


def test_repeated_header_and_empty_file(spark, tmp_path):
    p = tmp_path / "d.csv"
    p.write_text("Fwd Header Length,x,Fwd Header Length\n1,2,3\n")
    df = sources.read_export(spark, str(p))
    assert df.columns == ["Fwd Header Length", "x", "Fwd Header Length.1"]
    assert names.normalize_columns(df).columns == ["Fwd Header Length", "x"]
    (tmp_path / "e.csv").write_text("a,b\n")
    with pytest.raises(ValueError, match="no data rows"):
        sources.read_export(spark, str(tmp_path / "e.csv"))
    (tmp_path / "z.csv").write_text("")
    with pytest.raises(ValueError):
        sources.read_export(spark, str(tmp_path / "z.csv"))
    assert sources.sniff_delimiter("single") == ","


def test_decision_log_skips_bad_lines(spark, tmp_path):
    p = tmp_path / "log.jsonl"
    good = {"timestamp": "2026-08-21T21:33:38.903316+00:00", "challenger": "m1", "champion": None, "promoted": True, "decision": "PROMOTED", "thresholds": {"max_mean_fnr": 0.1}}
    p.write_text(json.dumps(good) + "\n\n{broken\n" + json.dumps({**good, "challenger": "m2", "champion": "m1", "timestamp": "2026-08-21T21:39:05+00:00"}) + "\n")
    got = sources.read_decisions(spark, str(p)).collect()
    assert [r["challenger"] for r in got] == ["m1", "m2"]
    assert sources.read_decisions(spark, str(tmp_path / "none")).count() == 0


def test_external_batch_snapshot_and_splits(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_text("flow duration,Flow Duration\n3,9\n")
    params = Parameters(["Flow Duration"], {"Flow Duration": 0.0}, {"Flow Duration": 1.0}, {"Flow Duration": 2.0})
    assert sources.read_external_batch(spark, str(p), params).columns == ["Flow Duration"]
    assert sources.read_snapshot(spark, str(tmp_path / "none")) is None
    with pytest.raises(FileNotFoundError):
        sources.read_prepared(spark, str(tmp_path / "none"), ["a"])
    ready = spark.createDataFrame([("train", 1, "DoS", 1.0, 2.0), ("test", 0, "BENIGN", 3.0, 4.0)], "split string, label_int int, label_class string, a double, b double")
    sinks.write_splits(ready, str(tmp_path / "ready"))
    train, test = sources.read_prepared(spark, str(tmp_path / "ready"), ["b", "a"])
    assert train.columns == ["label_int", "label_class", "b", "a"] and test.first()["b"] == 4.0


def test_catalogue_reports_broken_dataset(spark, tmp_path):
    (tmp_path / "good.csv").write_text("a,b\n1,2\n3,4\n")
    (tmp_path / "bad.csv").write_text("")
    got = {r["name"]: r for r in sources.catalogue(spark, str(tmp_path), lambda df: df.agg(F.count("*").alias("rows")), first="good.csv").collect()}
    assert json.loads(got["good"]["profile"]) == {"rows": 2} and got["good"]["position"] == 0
    assert got["bad"]["profile"] is None and got["bad"]["error"]


def test_report_and_odd_names_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1.0, INF)], "a double, b double")
    sinks.write_report(sinks.plain_json(df), str(tmp_path / "r"))
    assert json.loads(next((tmp_path / "r").glob("part-*")).read_text()) == {"a": 1.0, "b_text": "Infinity"}
    odd = df.toDF("Flow Bytes/s", "Idle.Mean")
    sinks.write_clean(odd, str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "c")).columns == ["Flow Bytes/s", "Idle.Mean"]
    sinks.write_flow_log(odd, str(tmp_path / "log"))
    assert next((tmp_path / "log").glob("part-*")).read_text().startswith("Flow Bytes/s,Idle.Mean")


def test_preparer_survives_saving(spark, tmp_path):
    """Estimator and fitted model come back from storage and give equal rows in another session."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=300)
    rows = [(float(a) if i % 7 else None, float(2 * a), float(b)) for i, (a, b) in enumerate(zip(x, rng.normal(size=300)))]
    df = spark.createDataFrame(rows, "`Flow Bytes/s` double, `Idle.Mean` double, plain double")
    stage = FlowPreparer(df.columns, "mean", 0.9, "standard", sketch=100)
    stage.write().save(str(tmp_path / "stage"))
    again = FlowPreparer.load(str(tmp_path / "stage"))
    assert {p.name: again.getOrDefault(p) for p in again.params} == {p.name: stage.getOrDefault(p) for p in stage.params}
    model = Pipeline(stages=[again]).fit(df)
    model.write().save(str(tmp_path / "model"))
    loaded = PipelineModel.load(str(tmp_path / "model"))
    assert loaded.stages[0].dropped == ["Idle.Mean"] and loaded.stages[0].parameters == model.stages[0].parameters
    other = spark.newSession().createDataFrame(rows, df.schema)
    assert loaded.transform(other).collect() == model.transform(df).collect()


def test_json_documents_lie_in_one_folder(spark, tmp_path, monkeypatch):
    from catalogue import exports

    spark.range(2500).selectExpr("id AS event_id", "id / 2 AS value", "concat('kind ', id % 3) AS event_type").write.parquet(str(tmp_path / "events.parquet"))
    monkeypatch.setattr(exports, "shared_dir", lambda _, purpose: str(tmp_path / "shared" / purpose))
    got = exports.json_documents(spark, str(tmp_path)).groupBy("form").agg(F.count("*"), F.countDistinct("event_id"), F.sum("value"))
    assert sorted(map(tuple, got.collect())) == [(form, 2500, 2500, 2499 * 625.0) for form in ("array", "flows", "records")]
    folders = list((tmp_path / "shared").glob("flows-*.json"))
    assert len(folders) == 3 and all(len([f for f in d.glob("part-*") if f.stat().st_size]) == 3 and not list(d.glob("part=*")) for d in folders)


@pytest.mark.parametrize("encoding", ["utf-8", "utf-8-sig", "utf-16-le"])
def test_documents_of_many_lines_in_a_folder(spark, tmp_path, encoding):
    folder = tmp_path / "x.json"
    folder.mkdir()
    for k, rows in enumerate([[{"id": 1}, {"id": 2, "v": "ä"}], [{"id": 2.5}], [{"id": 4, "w": True}]]):
        (folder / f"{k}.json").write_text(json.dumps({"meta": k, "flows": rows}, indent=2, ensure_ascii=False), encoding=encoding)
    got = sources.read_export(spark, str(folder))
    assert dict(got.dtypes) == {"id": "double", "v": "string", "w": "boolean"}
    assert sorted((r["id"], r["v"], r["w"]) for r in got.collect() if r["id"] != 1) == [(2.0, "ä", None), (2.5, None, None), (4.0, None, True)]
    assert sources._many_texts(spark, str(folder)) == (encoding == "utf-8")
    if encoding == "utf-8":
        schema = sources._schema_of_documents(spark, str(folder))
        assert schema == spark.read.option("multiLine", True).json(str(folder)).schema

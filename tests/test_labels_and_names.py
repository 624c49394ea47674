import pytest
from pyspark.sql import functions as F

from tidewatch import config
from tidewatch.functions import labels, names, numeric, verdict

BAD = "�"
PAIRS = [
    ("Benign", "BENIGN"), ("Bot", "Botnet"), ("DDoS", "DDoS"), ("DoS GoldenEye", "DoS"), ("DoS Hulk", "DoS"),
    ("DoS Slowhttptest", "DoS"), ("DoS slowloris", "DoS"), ("FTP-Patator", "BruteForce"), ("Heartbleed", "DoS"),
    ("Infiltration", "Infiltration"), ("PortScan", "PortScan"), ("SSH-Patator", "BruteForce"),
    (f"Web Attack {BAD} Brute Force", "WebAttack"), (f"Web Attack {BAD} XSS", "WebAttack"), (f"Web Attack {BAD} Sql Injection", "WebAttack"),
    ("Web Attack - Brute Force", "WebAttack"), ("Web Attack - XSS", "WebAttack"), ("Web Attack - Sql Injection", "WebAttack"),
]


def test_every_raw_label_maps(spark):
    df = spark.createDataFrame(PAIRS, "Label string, want string")
    out = labels.map_labels_strict(df)
    assert out.where("label_class <> want OR label_class IS NULL").count() == 0
    assert labels.unknown_labels(df).count() == 0


@pytest.mark.parametrize("raw", ["  x  y ", "\t a \n", f"{BAD}lead", " nbsp ", "a   b  c", "\x1cctl\x1f", f"a{BAD}b"])
def test_normalise_agrees_with_driver_form(spark, raw):
    got = spark.createDataFrame([(raw,)], "x string").select(labels.normalize_label(F.col("x"))).first()[0]
    assert got == labels.normalize_label_text(raw)


def test_unknown_and_missing_labels_fail(spark):
    df = spark.createDataFrame([("Benign",), ("mystery",), (None,)], "Label string")
    with pytest.raises(ValueError, match="mystery"):
        labels.check_labels(df)
    with pytest.raises(Exception, match="unknown label"):
        labels.map_labels_strict(df).collect()
    with pytest.raises(TypeError):
        labels.normalize_label_text(None)


def test_label_map_collision(spark):
    with pytest.raises(ValueError, match="collision"):
        labels.label_dimension(spark, {"a  b": "X", "a b": "Y"})


def test_truth_strings(spark):
    rows = ["BENIGN", "Benign", "DoS Hulk", "DoS", f"Web Attack {BAD} XSS", "nonsense"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, raw string")
    got = [r["truth"] for r in labels.resolve_truth(df, "raw").orderBy("i").collect()]
    assert got == ["BENIGN", "BENIGN", "DoS", "DoS", "WebAttack", None]


def test_encode_unknown_class_fails(spark):
    with pytest.raises(Exception, match="unknown class"):
        labels.encode_labels(spark.createDataFrame([("Other",)], "label_class string")).collect()


def test_headers():
    feats = ["Flow Duration", "Fwd Packets Length Total", "Packet Length Min", "Flow Bytes/s"]
    got = names.resolve_headers(
        [" Flow Duration ", "flow_duration", "FLOW-DURATION", "Total Length of Fwd Packets", "Min Packet Length", "flow.bytes/S", "Mystery"], feats
    )
    assert got == ["Flow Duration"] * 3 + ["Fwd Packets Length Total", "Packet Length Min", "Flow Bytes/s", "Mystery"]
    # Without the feature list, case variants outside the alias table stay.
    assert names.resolve_headers(["flow_duration", "min_packet_length"]) == ["flow_duration", "Packet Length Min"]


def test_duplicates_keep_first(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int").toDF("Fwd Header Length", " Fwd Header Length.1", "x.y/z")
    out = names.normalize_columns(df)
    assert out.columns == ["Fwd Header Length", "x.y/z"]
    assert out.first() == (1, 3)


def test_label_column_pick_is_case_sensitive(spark):
    df = spark.createDataFrame([("a", "b")], "x string, y string").toDF("label", "Label")
    assert names.label_column(df) == "Label"
    assert names.extract_labels(df).select("truth_raw").first()[0] == "b"


def test_missing_features_and_unused(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "a double, b double")
    with pytest.raises(ValueError, match="zz"):
        names.select_features(df, ["a", "zz"])
    assert names.unused_columns(["b", "a", "Flow ID", "Label", "zeta"], ["a"]) == ["b", "zeta"]
    with pytest.raises(ValueError):
        names.shared_columns(df, spark.createDataFrame([(1,)], "c int"))


def test_lenient_numbers(spark):
    texts = ["1.5", " 2 ", "1e3", "inf", "-Infinity", "nan", "1d", "1.5f", "0x1p3", "", "abc", None, ".5", "5.", "+7"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r["v"] for r in df.select("i", numeric.to_number(F.col("t")).alias("v")).orderBy("i").collect()]
    assert got[:5] == [1.5, 2.0, 1000.0, float("inf"), float("-inf")]
    assert got[5] != got[5] and got[6:12] == [None] * 6 and got[12:] == [0.5, 5.0, 7.0]


def test_thresholds_and_direction(spark):
    df = spark.createDataFrame([(0.30,), (0.20,), (0.10,), (0.01,)], "r double")
    assert [r[0] for r in df.select(verdict.threat_level(F.col("r"))).collect()] == ["HIGH", "HIGH", "MEDIUM", "LOW"]
    signs = spark.createDataFrame([(0.5, True), (-0.5, True), (0.5, False), (-0.5, False)], "s double, a boolean")
    assert [r[0] for r in signs.select(verdict.increases_threat(F.col("s"), F.col("a"))).collect()] == [True, False, False, True]


def test_argmax_first_on_ties(spark):
    df = spark.createDataFrame([([0.4, 0.4, 0.2],)], "p array<double>")
    assert df.select(verdict.argmax_class(F.col("p"), ["a", "b", "c"])).first()[0] == "a"
    assert [verdict.bin_label(*b) for b in config.CONFIDENCE_BINS] == ["0%-50%", "50%-60%", "60%-70%", "70%-80%", "80%-90%", "90%-100%"]
    got = df.select(verdict.bin_label_expr(F.lit(0.9), F.lit(1.0001)), verdict.millis_to_iso(F.lit(0)), verdict.reason_text(F.array(F.lit("a" * 500)))).first()
    assert got[0] == "90%-100%" and got[1] == "1970-01-01T00:00:00.000Z" and len(got[2]) == 480

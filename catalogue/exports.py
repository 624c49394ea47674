"""Exports, parameters, reports and resumed feeds: whole tables written out and read back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import names
from tidewatch.operators import quality
from tidewatch.operators.scaling import Parameters
from tidewatch.session import local_table, shared_dir
from tidewatch.sources import flows as sources
from tidewatch.sources import sinks
from tidewatch.streaming import feed

from . import fixtures as fx
from .fixtures import finite_sql, ident, sql

QUERIES, SQL = {}, {}

#: Flows in one JSON document.
DOCUMENT = 1000


def register(name: str, fn, oracle: str) -> None:
    QUERIES[name] = fn
    SQL[name] = oracle


# readers ------------------------------------------------------------------------

_FORMS = {"flows": ('{"flows": [', "]}"), "records": ('{"version": 1, "records": [', "]}"), "array": ("[", "]")}


def json_documents(spark, sf):
    """One document per thousand flows, as an array and under two record keys."""
    rows = fx.table(spark, sf, "events").select(
        F.floor(F.col("event_id") / DOCUMENT).alias("part"), F.to_json(F.struct("event_id", "value", "event_type")).alias("record"))
    parts = []
    for form, (head, tail) in _FORMS.items():
        path = shared_dir(spark, f"flows-{form}") + ".json"
        body = F.concat(F.lit(head), F.array_join(F.collect_list("record"), ","), F.lit(tail)).alias("value")
        # A file each, all in one folder that is listed at once; tasks put their files in place themselves.
        files = rows.groupBy("part").agg(body).select("value").write.option("maxRecordsPerFile", 1)
        files.option("mapreduce.fileoutputcommitter.algorithm.version", 2).text(path)
        parts.append(sources.read_export(spark, path).select(F.lit(form).alias("form"), "event_id", "value", "event_type"))
    return reduce(DataFrame.unionByName, parts)


register("source_json_documents", json_documents,
         "SELECT form, event_id, value, event_type FROM events, (VALUES ('flows'), ('records'), ('array')) AS t(form)")


def parquet_export(spark, sf):
    path = shared_dir(spark, "flows") + ".parquet"
    fx.table(spark, sf, "events").select("event_id", "value", "event_type").write.parquet(path)
    return sources.read_export(spark, path)


register("source_parquet_export", parquet_export, "SELECT event_id, value, event_type FROM events")


def padded_manifest(spark, sf):
    """Files with blanks around their column names, one with a narrower number type."""
    root = shared_dir(spark, "manifest")
    rows = fx.features(spark, sf)
    for i, f in enumerate(fx.FILES.values()):
        one = rows.where(F.col("source_file") == f).drop("source_file")
        one = one.withColumn("Zero", F.col("Zero").cast("int")) if i == 1 else one
        one.toDF(*[f" {n}" if i == 2 else f"{n} " for n in one.columns]).write.parquet(f"{root}/{f}")
    scan, _ = sources.read_manifest(spark, root, list(fx.FILES.values()))
    return scan.groupBy("source_file", "Label").agg(F.count("*").alias("rows"), F.sum("Zero").alias("zero"), F.round(F.sum("Charge"), 2).alias("charge"))


register("source_manifest_padded", padded_manifest, sql(
    ["features"], 'SELECT source_file, "Label", count(*) AS rows, sum("Zero") AS zero, round(sum("Charge"), 2) AS charge FROM features GROUP BY source_file, "Label"'))


def prepared_tables(spark, sf):
    """Both splits by the prepared reader, with the features in the order asked for."""
    path = shared_dir(spark, "prepared")
    rows = fx.labelled(spark, sf).select(
        "event_id", "value", F.col("class_id").alias("label_int"), "label_class", F.when(F.col("event_id") % 5 == 0, "test").otherwise("train").alias("split"))
    sinks.write_splits(rows, path)
    sides = zip(("train", "test"), sources.read_prepared(spark, path, ["value", "event_id"]))
    parts = [side.toDF("label_int", "label_class", "first", "second").withColumn("split", F.lit(name)) for name, side in sides]
    return reduce(DataFrame.unionByName, parts)


register("source_prepared", prepared_tables, sql(
    ["labelled"], """SELECT CASE WHEN event_id % 5 = 0 THEN 'test' ELSE 'train' END AS split, class_id AS label_int, label_class,
 value AS "first", event_id AS "second" FROM labelled"""))

_SCALED = {"Total Packets": (20.0, 25.0, 8.0), "Idle.Mean": (0.0, 0.05, 0.5), "Charge": (50.0, 50.0, 4.0)}


def _parameters(spark):
    """A parameter table that went through storage; the reader checks the order."""
    order = list(_SCALED)
    fill, center, scale = ({f: v[i] for f, v in _SCALED.items()} for i in range(3))
    path = shared_dir(spark, "parameters")
    sinks.write_parameters(spark, Parameters(order, fill, center, scale), path)
    return sources.read_parameters(spark, path, order), path


def external_batches(spark, sf):
    """The feature table as Parquet and as CSV with blanks around its headers, in the scaled space."""
    params, _ = _parameters(spark)
    rows = fx.features(spark, sf).select(*[names.c(n) for n in _SCALED]).toDF(" Total Packets", "Idle.Mean ", " Charge ")
    parquet, text = shared_dir(spark, "batch") + ".parquet", shared_dir(spark, "batch") + ".csv"
    rows.write.parquet(parquet)
    sinks.write_flow_log(rows, text)
    parts = []
    for form, path in (("parquet", parquet), ("csv", text)):
        one = sources.read_external_batch(spark, path, params).toDF("packets", "idle", "charge")
        parts.append(fx.rounded(one, one.columns).withColumn("form", F.lit(form)))
    return reduce(DataFrame.unionByName, parts)


_outs = ", ".join(
    f"round((coalesce({finite_sql(ident(n))}, {fill}) - {center}) / {scale}, 6) AS {out}"
    for out, (n, (fill, center, scale)) in zip(("packets", "idle", "charge"), _SCALED.items()))
register("source_external_batch", external_batches, sql(["features"], f"SELECT form, {_outs} FROM features, (VALUES ('parquet'), ('csv')) AS t(form)"))


def dataset_catalogue(spark, sf):
    """Two data sets and one without rows, which is reported and does not stop the others."""
    root = shared_dir(spark, "datasets")
    rows = fx.table(spark, sf, "events").select("event_id", "value")
    for name, test in (("even", "event_id % 2 = 0"), ("odd", "event_id % 2 = 1"), ("empty", "event_id IS NULL")):
        sinks.write_flow_log(rows.where(test), f"{root}/{name}.csv")
    found = sources.catalogue(spark, root, lambda df: df.agg(F.count("*").alias("rows")), first="odd.csv")
    return found.select("position", "name", F.get_json_object("profile", "$.rows").cast("long").alias("rows"), F.col("error").isNotNull().alias("failed"))


register("source_catalogue", dataset_catalogue, """SELECT 0 AS position, 'odd' AS name, count(*) AS rows, false AS failed FROM events WHERE event_id % 2 = 1
UNION ALL SELECT 1, 'empty', NULL, true UNION ALL SELECT 2, 'even', count(*), false FROM events WHERE event_id % 2 = 0""")


def _raised(kind, call) -> bool:
    try:
        call()
    except kind:
        return True
    return False


def refusals(spark, sf):
    """What the readers refuse, each tried on the feature table written out whole."""
    root = shared_dir(spark, "refused")
    rows = fx.features(spark, sf).drop("source_file")
    rows.write.parquet(f"{root}/a.parquet")
    rows.drop("Zero").write.parquet(f"{root}/b.parquet")
    rows.where("Label IS NULL").write.parquet(f"{root}/none.parquet")
    _, parameters = _parameters(spark)
    checks = {
        "no_rows": _raised(ValueError, lambda: sources.read_export(spark, f"{root}/none.parquet")),
        "file_missing": _raised(FileNotFoundError, lambda: sources.read_manifest(spark, root, ["a.parquet", "c.parquet"])),
        "columns_differ": _raised(ValueError, lambda: sources.read_manifest(spark, root, ["a.parquet", "b.parquet"])),
        "prepared_missing": _raised(FileNotFoundError, lambda: sources.read_prepared(spark, f"{root}/prepared", list(_SCALED))),
        "parameters_missing": _raised(FileNotFoundError, lambda: sources.read_parameters(spark, f"{root}/parameters")),
        "parameter_order": _raised(ValueError, lambda: sources.read_parameters(spark, parameters, list(_SCALED)[::-1])),
        "feature_missing": _raised(ValueError, lambda: names.select_features(rows, ["Charge", "Absent"])),
    }
    table = local_table(spark, list(checks.items()), "check string, raised boolean")
    return table.crossJoin(F.broadcast(spark.read.parquet(f"{root}/a.parquet").agg(F.count("*").alias("rows"))))


register("source_refusals", refusals, """SELECT "check", true AS raised, (SELECT count(*) FROM lineitem) AS rows FROM (VALUES ('no_rows'), ('file_missing'),
 ('columns_differ'), ('prepared_missing'), ('parameters_missing'), ('parameter_order'), ('feature_missing')) AS t("check")""")

# columns ------------------------------------------------------------------------

register(
    "label_column_picked",
    lambda s, d: names.extract_labels(fx.flows(s, d).select("event_id", F.col("event_type").alias("LABEL"), F.col("label_text").alias("label"))).select("event_id", "truth_raw"),
    sql(["flows"], "SELECT event_id, label_text AS truth_raw FROM flows"),
)


def unused_columns(spark, sf):
    rows = fx.flows(spark, sf).withColumnRenamed("label_text", "Label")
    unused = names.unused_columns(rows.columns, ["value"])
    counts = rows.agg(*[F.count(n).alias(n) for n in unused])
    return counts.select(F.posexplode(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).alias("cells")) for n in unused])).alias("position", "_c")).select("position", "_c.*")


_unused = ["event_id", "event_type", "truth_text", "ts", "user_id"]
register("export_unused_columns", unused_columns, sql(
    ["flows"], " UNION ALL ".join(f"SELECT {i} AS position, '{n}' AS feature, count({n}) AS cells FROM flows" for i, n in enumerate(_unused))))

# writers ------------------------------------------------------------------------


def clean_round_trip(spark, sf):
    """The clean table under its odd column names."""
    path = shared_dir(spark, "clean")
    sinks.write_clean(quality.replace_inf(fx.features(spark, sf, key=True), fx.NAMES), path)
    return spark.read.parquet(path).select(*fx.KEY, *[names.c(n).alias(names.canonical_key(n)) for n in fx.NAMES], "Label")


register("sink_clean_table", clean_round_trip, sql(
    ["features"], f'SELECT {", ".join(fx.KEY)}, ' + ", ".join(f"{finite_sql(ident(n))} AS {names.canonical_key(n)}" for n in fx.NAMES) + ', "Label" FROM features'))


def report_round_trip(spark, sf):
    """A report with infinite numbers, which JSON can hold only as text."""
    path = shared_dir(spark, "report")
    rate = names.c("Flow Bytes/s")
    report = fx.features(spark, sf).groupBy("source_file").agg(
        F.count("*").alias("rows"), F.max(F.when(~F.isnan(rate), rate)).alias("peak"), F.max("Charge").alias("charge"))
    sinks.write_report(sinks.plain_json(report), path, drop=["charge_text"])
    return spark.read.schema("source_file string, rows bigint, peak double, peak_text string, charge double").json(path)


register("sink_report", report_round_trip, sql(["features"], """SELECT source_file, rows, CASE WHEN NOT isinf(peak) THEN peak END AS peak, CASE WHEN isinf(peak) THEN 'Infinity' END AS peak_text, charge
FROM (SELECT source_file, count(*) AS rows, max("Flow Bytes/s") FILTER (NOT isnan("Flow Bytes/s")) AS peak, max("Charge") AS charge FROM features GROUP BY source_file)"""))


def flow_log(spark, sf):
    path = shared_dir(spark, "log") + ".csv"
    sinks.write_flow_log(fx.flows(spark, sf).select("event_id", "value", "label_text"), path)
    back = sources.read_export(spark, path)
    return back.select(F.col("event_id").cast("long").alias("event_id"), F.col("value").cast("double").alias("value"), F.trim("label_text").alias("label_text"))


register("sink_flow_log", flow_log, sql(["flows"], "SELECT event_id, value, trim(label_text) AS label_text FROM flows"))

# feeds --------------------------------------------------------------------------


def resumed_feed(spark, sf):
    """Four files, a stop, four more: the second run starts where the first one ended."""
    folder, out, mark = (shared_dir(spark, n) for n in ("feed", "batches", "mark"))
    rows = fx.table(spark, sf, "events").select("event_id", "value")
    for half in (0, 1):
        rows.where(F.col("event_id") % 2 == half).repartition(4).write.mode("append").parquet(folder)
        arriving = sources.read_feed(spark, folder, rows.schema, files_per_trigger=2)
        query = arriving.writeStream.option("checkpointLocation", mark).trigger(availableNow=True).foreachBatch(feed.batch_sink(out)).start()
        query.awaitTermination()
    batches = spark.read.parquet(out)
    return batches.withColumn("run", F.when(F.col("batch") < 2, 1).otherwise(2)).drop("batch")


register("stream_resumed", resumed_feed, "SELECT event_id, value, CAST(1 + event_id % 2 AS INT) AS run FROM events")

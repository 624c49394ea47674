"""Labels, quality, cleaning and source queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions import labels, names, verdict
from tidewatch.operators import cleaning, quality
from tidewatch.session import shared_dir
from tidewatch.sources import flows as sources
from tidewatch.sources import sinks

from . import fixtures as fx
from .fixtures import finite_sql, ident, norm_sql, sql

QUERIES, SQL = {}, {}


def register(name: str, fn, oracle: str | None) -> None:
    QUERIES[name] = fn
    if oracle:
        SQL[name] = oracle


# labels -------------------------------------------------------------------------

def label_forms(spark, sf):
    x = F.col("label_text")
    return (
        fx.flows(spark, sf).groupBy("label_text").agg(F.count("*").alias("n"))
        .select(labels.normalize_label(x).alias("norm"), labels.display_label(x).alias("display"),
                labels.safe_display(x).alias("safe"), names.canonical_key_expr(x).alias("key"), "n")
    )


register("label_forms", label_forms, sql(["flows"], f"""
SELECT {norm_sql('label_text')} AS norm, trim(regexp_replace(replace(label_text, '{fx.BAD}', ' - '), '\\s+', ' ', 'g')) AS display,
 replace(label_text, '{fx.BAD}', '<UFFFD>') AS safe, regexp_replace(lower(label_text), '[^a-z0-9]', '', 'g') AS key, n
FROM (SELECT label_text, count(*) AS n FROM flows GROUP BY label_text)"""))

register(
    "label_class_join",
    lambda s, d: labels.map_labels(fx.flows(s, d), "label_text").select("event_id", "label_class"),
    sql(["labelled"], "SELECT event_id, label_class FROM labelled"),
)
register(
    "label_unknown",
    lambda s, d: labels.unknown_labels(fx.flows(s, d), "truth_text"),
    sql(["flows", "label_map"], f"SELECT DISTINCT {norm_sql('truth_text')} AS norm FROM flows WHERE {norm_sql('truth_text')} NOT IN (SELECT norm FROM label_map)"),
)
register(
    "label_map_collisions",
    lambda s, d: labels.label_collisions(fx.flows(s, d), "label_text", "event_type"),
    sql(["flows"], f"SELECT {norm_sql('label_text')} AS norm, count(DISTINCT event_type) AS classes FROM flows GROUP BY 1 HAVING count(DISTINCT event_type) > 1"),
)
register(
    "label_codes",
    lambda s, d: labels.decode_labels(
        labels.encode_labels(labels.map_labels(fx.flows(s, d), "label_text"), out="label_int").select("event_id", "label_int"),
        out="decoded",
    ).select("event_id", "label_int", "decoded"),
    sql(["labelled"], "SELECT event_id, class_id AS label_int, label_class AS decoded FROM labelled"),
)
register(
    "label_truth_resolved",
    lambda s, d: labels.resolve_truth(fx.flows(s, d), "truth_text").select("event_id", "truth"),
    sql(["scored"], "SELECT event_id, truth FROM scored"),
)
register(
    "label_classes_outside",
    lambda s, d: labels.unknown_classes(fx.table(s, d, "events").select(F.upper("event_type").alias("label_class"))),
    sql(["classes"], "SELECT DISTINCT upper(event_type) AS label_class FROM events EXCEPT SELECT label_class FROM classes"),
)

# quality ------------------------------------------------------------------------

register(
    "quality_label_counts",
    lambda s, d: quality.label_counts(fx.features(s, d)),
    sql(["features"], """SELECT source_file, "Label", grouping(source_file) = 1 AS all_files, count(*) AS rows
FROM features GROUP BY GROUPING SETS (("Label", source_file), ("Label"))"""),
)
register(
    "quality_distinct_labels",
    lambda s, d: quality.distinct_labels(fx.features(s, d)),
    sql(["features"], 'SELECT source_file, count(DISTINCT "Label") AS labels FROM features GROUP BY source_file'),
)
_inf_cells = "CAST(sum(" + " + ".join(f"CASE WHEN isinf({ident(n)}) THEN 1 ELSE 0 END" for n in fx.NAMES) + ") AS BIGINT)"
_nan_cells = "CAST(sum(" + " + ".join(f"CASE WHEN {ident(n)} IS NULL OR isnan({ident(n)}) THEN 1 ELSE 0 END" for n in fx.NAMES) + ") AS BIGINT)"
register(
    "quality_cell_counts",
    lambda s, d: quality.cell_counts(fx.features(s, d), fx.NAMES, ["source_file"]),
    sql(["features"], f"SELECT source_file, {_inf_cells} AS inf_count, {_nan_cells} AS nan_count FROM features GROUP BY source_file"),
)
register(
    "quality_file_profile",
    lambda s, d: quality.file_profile(fx.features(s, d), fx.NAMES, len(fx.NAMES) + 1),
    sql(["features"], f"""SELECT source_file, count(*) AS rows, CAST({len(fx.NAMES) + 1} AS BIGINT) AS columns, {_inf_cells} AS inf_count,
 {_nan_cells} AS nan_count_numeric, CAST(count(*) - count("Label") AS BIGINT) AS nan_count_label, count(DISTINCT "Label") AS labels
FROM features GROUP BY source_file"""),
)
register(
    "quality_inf_by_column",
    lambda s, d: quality.inf_counts(fx.features(s, d), fx.NAMES),
    sql(["features"], " UNION ALL ".join(
        f"SELECT {i} AS pos, {fx.quoted(n)} AS feature, count(*) FILTER (isinf({ident(n)}) AND {ident(n)} > 0) AS pos_inf,"
        f" count(*) FILTER (isinf({ident(n)}) AND {ident(n)} < 0) AS neg_inf FROM features" for i, n in enumerate(fx.NAMES))),
)
register(
    "quality_inf_replaced",
    lambda s, d: quality.replace_inf(fx.features(s, d, key=True), fx.NAMES).select(*fx.KEY, names.c("Flow Bytes/s").alias("bytes"), names.c("Total Packets").alias("packets")),
    sql(["features"], f'SELECT {", ".join(fx.KEY)}, {finite_sql(ident("Flow Bytes/s"))} AS bytes, {finite_sql(ident("Total Packets"))} AS packets FROM features'),
)
_const = lambda by, extra: " UNION ALL ".join(
    f"SELECT {by}{i} AS pos, {fx.quoted(n)} AS feature FROM features {'GROUP BY ' + by.strip(', ') if by else ''}"
    f" HAVING min({finite_sql(ident(n))}) = max({finite_sql(ident(n))}) AND count({finite_sql(ident(n))}) >= 2 {extra.format(c=ident(n))}"
    for i, n in enumerate(fx.NAMES))
register(
    "quality_constant_at_load",
    lambda s, d: quality.constant_columns(fx.features(s, d), fx.NAMES, ["source_file"]),
    sql(["features"], _const("source_file, ", "AND count(*) FILTER (isinf({c})) = 0")),
)
register(
    "quality_constant_when_clean",
    lambda s, d: quality.constant_columns(fx.features(s, d), fx.NAMES, inf_breaks=False),
    sql(["features"], _const("", "")),
)
register(
    "quality_class_distribution",
    lambda s, d: fx.rounded(quality.class_distribution(fx.labelled(s, d)), ["percent"]),
    sql(["labelled"], "SELECT label_class, count(*) AS rows, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS percent FROM labelled GROUP BY label_class"),
)
register(
    "quality_missing_cells",
    lambda s, d: quality.missing_cells(fx.features(s, d), fx.NAMES, ["source_file"]),
    sql(["features"], " UNION ALL ".join(
        f"SELECT source_file, {i} AS pos, {fx.quoted(n)} AS feature, CAST(count(*) - count({finite_sql(ident(n))}) AS BIGINT) AS missing FROM features GROUP BY source_file"
        for i, n in enumerate(fx.NAMES))),
)
register(
    "quality_class_support",
    lambda s, d: quality.class_support(fx.labelled(s, d).withColumn("split", F.when(F.col("event_id") % 5 == 0, "test").otherwise("train")), "Infiltration"),
    sql(["labelled"], "SELECT CASE WHEN event_id % 5 = 0 THEN 'test' ELSE 'train' END AS split, count(*) FILTER (label_class = 'Infiltration') AS support FROM labelled GROUP BY 1"),
)

# cleaning -----------------------------------------------------------------------

_slim = ["Total Packets", "Idle.Mean", "Active Std", "Zero"]


def _coarse(spark, sf):
    """Few columns with few values, so that whole rows repeat across files."""
    return fx.features(spark, sf).select(*[names.c(n) for n in [*_slim, "Label", "source_file"]])


_slim_sql = ", ".join(ident(n) for n in _slim)
_order = {f: fx.config.MANIFEST.index(f) + 1 for f in fx.FILES.values()}
_first_file = (
    "CASE min(CASE source_file " + " ".join(f"WHEN '{f}' THEN {i}" for f, i in _order.items()) + " END) "
    + " ".join(f"WHEN {i} THEN '{f}'" for f, i in _order.items()) + " END"
)
register(
    "clean_deduplicated",
    lambda s, d: cleaning.deduplicate(_coarse(s, d)).select(
        *[names.c(n).alias(names.canonical_key(n)) for n in _slim], "Label", "source_file"),
    sql(["features"], "SELECT " + ", ".join(f"{ident(n)} AS {names.canonical_key(n)}" for n in _slim)
        + f', "Label", {_first_file} AS source_file FROM features GROUP BY {_slim_sql}, "Label"'),
)
register(
    "clean_distinct_rows",
    lambda s, d: cleaning.deduplicate(_coarse(s, d).drop("source_file", "Zero")).select(
        *[names.c(n).alias(names.canonical_key(n)) for n in _slim[:3]], "Label"),
    sql(["features"], "SELECT DISTINCT " + ", ".join(f"{ident(n)} AS {names.canonical_key(n)}" for n in _slim[:3]) + ', "Label" FROM features'),
)
_cells = lambda test: " + ".join(f"CASE WHEN {test.format(c=ident(n))} THEN 1 ELSE 0 END" for n in fx.NAMES)
_clean_cols = ", ".join(f"{finite_sql(ident(n))} AS {ident(n)}" for n in fx.NAMES)
register(
    "clean_counts",
    lambda s, d: cleaning.cleaning_counts(fx.features(s, d)),
    sql(["features"], f"""SELECT CAST(sum(n) AS BIGINT) AS input_rows, CAST(sum(inf) AS BIGINT) AS inf_replaced, CAST(sum(n * missing) AS BIGINT) AS missing_after,
 count(*) AS output_rows, CAST(sum(n) - count(*) AS BIGINT) AS duplicates_dropped FROM (
 SELECT {', '.join(ident(n) for n in fx.NAMES)}, "Label", count(*) AS n, sum(inf) AS inf, max({_cells('{c} IS NULL')}) AS missing FROM (
  SELECT {_clean_cols}, "Label", {_cells('isinf({c})')} AS inf FROM features) GROUP BY {', '.join(ident(n) for n in fx.NAMES)}, "Label")"""),
)


def clean_table(spark, sf):
    rows, _ = cleaning.clean(_coarse(spark, sf))
    n = [c for c in rows.columns if c not in names.config.META_COLUMNS]
    return rows.groupBy("label_class").agg(F.count("*").alias("rows"), F.lit(len(n)).cast("long").alias("feature_columns"))


register("clean_table", clean_table, sql(["features", "label_map"], f"""SELECT m.label_class, count(*) AS rows, CAST(3 AS BIGINT) AS feature_columns
FROM (SELECT DISTINCT {_slim_sql}, "Label" FROM features) f JOIN label_map m ON f."Label" = m.norm GROUP BY m.label_class"""))

# sources and sinks: write the table, read it back through the reader --------------

def manifest_scan(spark, sf):
    root = shared_dir(spark, "manifest")
    rows = fx.features(spark, sf)
    for f in fx.FILES.values():
        rows.where(F.col("source_file") == f).drop("source_file").write.parquet(f"{root}/{f}")
    scan, _ = sources.read_manifest(spark, root, list(fx.FILES.values()))
    return scan.groupBy("source_file", "Label").agg(F.count("*").alias("rows"), F.round(F.sum("Charge"), 2).alias("charge"))


register("source_manifest", manifest_scan, sql(["features"], 'SELECT source_file, "Label", count(*) AS rows, round(sum("Charge"), 2) AS charge FROM features GROUP BY source_file, "Label"'))


def delimited_scan(spark, sf):
    path = shared_dir(spark, "flows") + ".csv"
    fx.table(spark, sf, "events").select(F.col("event_id").alias(" Flow ID "), F.col("value").alias("flow_value"), F.col("event_type").alias("Label")).write.option("header", True).option("sep", ";").csv(path)
    df = names.normalize_columns(sources.read_export(spark, path), ["Flow Value"])
    return df.select(names.c("Flow ID").cast("long").alias("flow_id"), names.c("Flow Value").cast("double").alias("flow_value"), names.c("Label").alias("label"))


register("source_delimited", delimited_scan, "SELECT event_id AS flow_id, value AS flow_value, event_type AS label FROM events")


def json_lines_scan(spark, sf):
    path = shared_dir(spark, "flows") + ".jsonl"
    fx.table(spark, sf, "events").select("event_id", "value", "event_type").write.json(path)
    return sources.read_export(spark, path).select("event_id", "value", "event_type")


register("source_json_lines", json_lines_scan, "SELECT event_id, value, event_type FROM events")


def class_folder(spark, sf):
    path = shared_dir(spark, "by-class")
    sinks.write_by_class(fx.labelled(spark, sf).select("event_id", "value", "label_class"), path)
    return sources.read_class(spark, path, "PortScan").select("event_id", "value")


register("source_one_class", class_folder, sql(["labelled"], "SELECT event_id, value FROM labelled WHERE label_class = 'PortScan'"))


def picked_rows(spark, sf):
    rows = fx.labelled(spark, sf)
    picked = rows.where("label_class = 'Botnet'").select("event_id")
    return sources.rows_by_key(rows, picked, "event_id", ["value", "event_type"])


register("source_picked_rows", picked_rows, sql(["labelled"], "SELECT event_id, value, event_type FROM labelled WHERE label_class = 'Botnet'"))
register(
    "props_round_trip",
    lambda s, d: fx.table(s, d, "events").select(
        "event_id", F.get_json_object("props", "$.k").cast("long").alias("k"),
        F.from_json(F.to_json(F.struct(F.from_json("props", "k bigint").alias("p"))), "p struct<k: bigint>")["p"]["k"].alias("again")),
    "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(json_extract(props, '$.k') AS BIGINT) AS again FROM events",
)
register(
    "protocol_names",
    lambda s, d: fx.table(s, d, "events").select(
        "event_id", verdict.protocol_name(F.expr("CASE WHEN event_id % 4 = 0 THEN 6 WHEN event_id % 4 = 1 THEN 17 WHEN event_id % 4 = 2 THEN 0 ELSE event_id % 256 END")).alias("protocol_name")),
    """SELECT event_id, CASE p WHEN 6 THEN 'TCP' WHEN 17 THEN 'UDP' WHEN 0 THEN 'HOPOPT' ELSE 'OTHER' END AS protocol_name
FROM (SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 6 WHEN event_id % 4 = 1 THEN 17 WHEN event_id % 4 = 2 THEN 0 ELSE event_id % 256 END AS p FROM events)""",
)

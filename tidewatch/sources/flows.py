"""Readers for flow tables, exports, snapshots, parameters and the decision log."""

from __future__ import annotations

import csv
import json
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import config
from ..functions.names import c, normalize_columns, select_features
from ..operators.preparing import prepare
from ..operators.scaling import PARAMETER_SCHEMA, Parameters
from ..session import local_table

DELIMITERS = [",", "\t", ";", "|"]
# Keys under which exporters wrap their records, in the order they are tried.
RECORD_KEYS = ["flows", "data", "records", "rows", "results"]


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def list_names(spark: SparkSession, directory: str) -> list[str]:
    fs, p = _fs(spark, directory)
    if not fs.exists(p):
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(p))


def drop(spark: SparkSession, path: str) -> None:
    """Delete a folder that this package wrote and has replaced."""
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def read_manifest(
    spark: SparkSession, directory: str, manifest: Sequence[str] = config.MANIFEST
) -> tuple[DataFrame, dict[str, list[str]]]:
    """Scan the manifest's files as one table with ``source_file``.

    Missing files fail with the full list; other Parquet files are reported and not
    read. The files must hold the same ordered columns after stripping blanks.
    Only footers are read here.
    """
    have = set(list_names(spark, directory))
    missing = [m for m in manifest if m not in have]
    if missing:
        raise FileNotFoundError(f"missing Parquet files in {directory}: {missing}")
    extra = sorted(n for n in have - set(manifest) if n.endswith(".parquet"))
    paths = [f"{directory.rstrip('/')}/{m}" for m in manifest]
    schemas = [spark.read.parquet(p).schema for p in paths]
    stripped = [[n.strip() for n in s.names] for s in schemas]
    for m, names in zip(manifest, stripped):
        if names != stripped[0]:
            raise ValueError(f"columns of {m} differ: {sorted(set(names) ^ set(stripped[0]))}")
    types = [[f.dataType for f in s.fields] for s in schemas]
    raw = [s.names for s in schemas]
    if all(t == types[0] for t in types) and all(r == raw[0] for r in raw):
        scan = spark.read.schema(schemas[0]).parquet(*paths)
        names = [F.col(f"_metadata.file_path").alias("_path"), *[c(n).alias(n.strip()) for n in raw[0]]]
        table = scan.select(*names)
        # First path element below the directory: the file, or a folder of parts.
        entry = F.element_at(F.split(F.url_decode("_path"), "/"), -1 if _plain_files(spark, paths) else -2)
        table = table.withColumn("source_file", entry).drop("_path")
    else:
        # Same names, other numeric widths: bring every file to the widest type.
        parts = []
        for m, p, names in zip(manifest, paths, stripped):
            parts.append(spark.read.parquet(p).toDF(*names).withColumn("source_file", F.lit(m)))
        table = _union_widened(parts)
    return table, {"missing": missing, "ignored": extra}


def _plain_files(spark: SparkSession, paths: Sequence[str]) -> bool:
    fs, _ = _fs(spark, paths[0])
    kinds = {bool(fs.getFileStatus(_fs(spark, p)[1]).isFile()) for p in paths}
    if len(kinds) > 1:
        raise ValueError("manifest mixes plain files and folders of part files")
    return kinds.pop()


def _union_widened(parts: Sequence[DataFrame]) -> DataFrame:
    names = parts[0].columns
    wide = [n for n in names if len({p.schema[n].dataType for p in parts}) > 1]
    out = None
    for p in parts:
        p = p.select(*[c(n).cast("double").alias(n) if n in wide else c(n) for n in names])
        out = p if out is None else out.unionByName(p)
    return out


def sniff_delimiter(header: str) -> str:
    """The candidate that occurs most often in the header; a comma if none does."""
    counts = {d: header.count(d) for d in DELIMITERS}
    best = max(DELIMITERS, key=counts.get)
    return best if counts[best] else ","


def read_delimited(spark: SparkSession, path: str) -> DataFrame:
    """Delimited text as string columns, under the file's own header.

    A repeated header gets ``.1``, ``.2`` and so on, as exporters' readers do.
    """
    first = spark.read.text(path).first()
    if first is None or not first[0].strip():
        raise ValueError(f"{path} is empty")
    header = first[0].lstrip("﻿").rstrip("\r")
    sep = sniff_delimiter(header)
    names, seen = [], {}
    for n in next(csv.reader([header], delimiter=sep)):
        k = seen.get(n, 0)
        seen[n] = k + 1
        names.append(f"{n}.{k}" if k else n)
    schema = T.StructType([T.StructField(f"_c{i}", T.StringType()) for i in range(len(names))])
    return spark.read.csv(path, schema=schema, sep=sep, header=True, escape='"').toDF(*names)


def _many_texts(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` is a folder of documents in UTF-8 without a mark; only the reader of files tells other encodings."""
    fs, p = _fs(spark, path)
    if not fs.exists(p) or fs.getFileStatus(p).isFile():
        return False
    other = F.col("value").contains("\0") | F.col("value").startswith("\ufeff")
    return spark.read.text(path, wholetext=True).where(other).isEmpty()


def _schema_of_documents(spark: SparkSession, path: str) -> T.StructType:
    """The schema of all documents in a folder.

    The reader of files puts up to 128 MB of documents in a task to find it. As texts, they are dealt
    to tasks with the cost of opening each, as when they are read.
    """
    texts = spark.read.text(path, wholetext=True).select("value")
    return spark.read.json(texts.rdd.map(lambda r: r[0])).schema


def read_json_records(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array, records under a known key, or a single record.

    A JSON document is parsed by one task per file, so large exports should come as
    many files or as newline-delimited JSON. An object of equal-length columns is
    one record, as it is on upload.
    """
    reader = spark.read.option("multiLine", True)
    df = (reader.schema(_schema_of_documents(spark, path)) if _many_texts(spark, path) else reader).json(path)
    for key in RECORD_KEYS:
        if key in df.columns and isinstance(df.schema[key].dataType, T.ArrayType):
            return df.select(F.explode(c(key)).alias("_r")).select("_r.*")
    return df


def read_export(spark: SparkSession, path: str) -> DataFrame:
    """A flow export by its suffix; no rows is an error."""
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if suffix == "parquet":
        df = spark.read.parquet(path)
    elif suffix in ("jsonl", "ndjson"):
        df = spark.read.json(path)
    elif suffix == "json":
        df = read_json_records(spark, path)
    else:
        df = read_delimited(spark, path)
    if df.isEmpty():
        raise ValueError(f"{path} holds no data rows")
    return df


def rows_by_key(df: DataFrame, picked: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Chosen rows with chosen columns; the pick needs only the key."""
    return df.select(*[c(n) for n in [key, *columns]]).join(picked.select(key), key, "left_semi")


def read_class(spark: SparkSession, path: str, cls: str) -> DataFrame:
    """One class of a table written by class; only its folder is read."""
    return spark.read.parquet(path).where(F.col("label_class") == cls)


def read_prepared(spark: SparkSession, path: str, features: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Train and test rows with ordered features and labels; a missing table is an error."""
    if not exists(spark, path):
        raise FileNotFoundError(f"prepared table not found: {path}")
    table = spark.read.parquet(path)
    picked = lambda s: select_features(table.where(F.col("split") == s), features, ["label_int", "label_class"])
    return picked("train"), picked("test")


def read_snapshot(spark: SparkSession, path: str) -> DataFrame | None:
    return spark.read.parquet(path) if exists(spark, path) else None


def read_parameters(spark: SparkSession, path: str, features: Sequence[str] | None = None) -> Parameters:
    """Parameter table from storage, checked; the order must be the model's if given."""
    if not exists(spark, path):
        raise FileNotFoundError(f"parameter table not found: {path}")
    params = Parameters.from_df(spark.read.schema(PARAMETER_SCHEMA).json(path))
    if features is not None:
        params.check_order(features)
    return params


METRICS = "macro_f1 double, mean_attack_fnr double, macro_attack_f1 double, accuracy double, worst_attack_class string, worst_attack_fnr double"
DECISION_SCHEMA = (
    "seq bigint, timestamp string, challenger string, champion string, decision string, promoted boolean, "
    "gates array<struct<gate:string,passed:boolean,detail:string>>, reasons array<string>, "
    "thresholds struct<min_f1_improvement:double,max_mean_fnr:double,max_per_class_fnr:double>, "
    f"challenger_metrics struct<{', '.join(f'{a.split()[0]}:{a.split()[1]}' for a in METRICS.split(', '))}>, "
    f"champion_metrics struct<{', '.join(f'{a.split()[0]}:{a.split()[1]}' for a in METRICS.split(', '))}>"
)


def read_decisions(spark: SparkSession, path: str) -> DataFrame:
    """The decision log without blank and malformed lines, oldest first by ``seq``.

    A log without ``seq`` gets one from its timestamps. The log has one line per
    decision, so ordering it is cheap.
    """
    if not exists(spark, path):
        return spark.createDataFrame([], DECISION_SCHEMA)
    schema = DECISION_SCHEMA + ", _corrupt_record string"
    # The parsed lines are kept: a filter on the corrupt column alone may not re-read the file.
    rows = spark.read.schema(schema).json(path).cache()
    good = rows.where("_corrupt_record IS NULL AND challenger IS NOT NULL").drop("_corrupt_record")
    by_time = F.to_timestamp("timestamp").cast("double") * 1e6
    return good.withColumn("seq", F.coalesce("seq", by_time.cast("long"))).orderBy("seq")


def read_external_batch(spark: SparkSession, path: str, params: Parameters) -> DataFrame:
    """A traffic file in the scaled space of the reference."""
    raw = spark.read.parquet(path) if path.rstrip("/").lower().endswith(".parquet") else read_delimited(spark, path)
    return prepare(normalize_columns(raw), params, normalized=True, allow_missing=True, flag_filled=False)


def read_feed(spark: SparkSession, directory: str, schema: T.StructType, files_per_trigger: int = 1, pattern: str | None = None) -> DataFrame:
    """Continuous flow feed; the checkpoint of the query is the resume position."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.parquet(directory)


def catalogue(
    spark: SparkSession, directory: str, profile: Callable[[DataFrame], DataFrame], suffix: str = ".csv", first: str | None = None
) -> DataFrame:
    """One profile row per dataset in a directory; one that cannot be read gives an error row.

    Each dataset is profiled by its own job, so a broken one cannot fail the rest.
    """
    names = [n for n in list_names(spark, directory) if n.lower().endswith(suffix)]
    if first in names:
        names = [first, *[n for n in names if n != first]]
    schema = "position int, name string, filename string, profile string, error string"
    rows = []
    for i, n in enumerate(names):
        try:
            one = profile(read_export(spark, f"{directory.rstrip('/')}/{n}"))
            row = json.loads(one.select(F.to_json(F.struct("*")).alias("j")).first()["j"])
            rows.append((i, n[: -len(suffix)], n, json.dumps(row, sort_keys=True), None))
        except Exception as failure:  # noqa: BLE001 - the row reports it
            rows.append((i, n[: -len(suffix)], n, None, str(failure).splitlines()[0]))
    return local_table(spark, rows, schema)

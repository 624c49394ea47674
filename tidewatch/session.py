"""Session helpers shared by jobs, tests and the benchmark."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

# A side is broadcast only when the caller can prove it has at most this many rows.
BROADCAST_ROWS = 100_000


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """Session for tests and the local benchmark; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tidewatch")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh path below the cluster's shared checkpoint folder.

    ``spark.checkpoint.dir`` names that folder. Only where nothing is set and the session runs in one
    process, as in tests, a temporary folder is chosen and remembered in the session.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or _checkpoint_dir(spark)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="run-")
        spark.conf.set("tidewatch.scratch", root)
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def _checkpoint_dir(spark: SparkSession) -> str | None:
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    return found or spark.conf.get("tidewatch.scratch", None)


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: computed once, lineage cut."""
    path = shared_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded(df: DataFrame, rows: int) -> DataFrame:
    """Mark ``df`` for broadcast when ``rows`` is a proven bound that is small enough.

    Above the bound the frame is returned as it is and the planner picks the join.
    """
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def local_table(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A small table of constants that the planner knows the size of (a local relation)."""
    fields = to_arrow_schema(T.StructType.fromDDL(schema))
    columns = list(zip(*rows)) if rows else [()] * len(fields)
    arrays = [pa.array(list(values), type=f.type) for values, f in zip(columns, fields)]
    return spark.createDataFrame(pa.table(arrays, schema=fields))

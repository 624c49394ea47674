"""Scoring, running statistics, timeline, recent flows and drift on a flow feed."""

from __future__ import annotations

import heapq
import json
from collections import defaultdict
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming import StreamingQuery

from .. import config
from ..functions.numeric import ratio
from ..functions.verdict import class_array, threat_level
from ..operators.drift import ValueHistogram, detect_drift, value_histogram
from ..operators.scoring import with_verdict
from ..session import shared_dir
from ..sources.flows import drop, list_names

#: Entries of the state store that the sessions of a feed are dealt to.
SESSION_GROUPS = 1024


def score_feed(feed: DataFrame, probs: str = "probs", classes: Sequence[str] = config.CLASSES) -> DataFrame:
    """Row-wise verdicts: the batch function on a streaming frame."""
    return with_verdict(feed, probs, classes)


def session_stats(
    scored: DataFrame, session: Sequence[str] = (), truth: str = "truth", classes: Sequence[str] = config.CLASSES,
    high: float = config.THREAT_HIGH, medium: float = config.THREAT_MEDIUM,
) -> DataFrame:
    """Running totals in one aggregation: flows, attacks, rate, level, classes, accuracy.

    Rows without truth count as flows and not in the accuracy.
    """
    known = F.col(truth).isNotNull()
    keys = list(session) or [F.lit("all").alias("session")]
    names = list(session) or ["session"]
    totals = scored.groupBy(*keys).agg(
        F.count("*").alias("flows"),
        F.count_if("is_attack").alias("attacks"),
        F.count_if(known).alias("labelled"),
        F.count_if(known & (F.col(truth) == F.col("prediction"))).alias("correct"),
        F.map_from_arrays(
            class_array(classes), F.array(*[F.count_if(F.col("prediction") == n) for n in classes])
        ).alias("by_class"),
    )
    rate = ratio(F.col("attacks"), F.col("flows"))
    return totals.select(
        *names, "flows", "attacks", (F.col("flows") - F.col("attacks")).alias("benign"), rate.alias("attack_rate"),
        threat_level(rate, high, medium).alias("threat_level"), "by_class", "labelled", "correct",
        F.when(F.col("labelled") > 0, F.try_divide("correct", "labelled")).alias("accuracy"),
    )


def timeline(scored: DataFrame, ts: str = "ts", width: str = "1 second", late: str = "10 seconds") -> DataFrame:
    """Benign and attack counts per second. Works on a stream and on a table.

    On a stream in append mode rows that are later than ``late`` are not counted; in update or complete mode a
    bucket stays open that long at least.
    """
    rows = scored.withWatermark(ts, late) if scored.isStreaming else scored
    return (
        rows.groupBy(F.window(ts, width).alias("w"))
        .agg(F.count_if("is_attack").alias("attacks"), F.count_if(~F.col("is_attack")).alias("benign"))
        .select(F.col("w.start").alias("bucket"), "benign", "attacks")
    )


def trim_timeline(buckets: DataFrame, keep: int = 40, bucket: str = "bucket") -> DataFrame:
    """Without the first and last bucket when there are more than two; the last ``keep``.

    Only the newest ``keep + 1`` buckets and the edges matter, so a sorted limit
    replaces a window over the whole history.
    """
    edges = buckets.agg(F.min(bucket).alias("_first"), F.max(bucket).alias("_last"), F.count("*").alias("_n"))
    inner = buckets.crossJoin(F.broadcast(edges)).where(
        (F.col("_n") <= 2) | ((F.col(bucket) > F.col("_first")) & (F.col(bucket) < F.col("_last")))
    )
    return inner.drop("_first", "_last", "_n").orderBy(F.desc(bucket)).limit(keep)


class LatestByKey:
    """The newest row of every key, from an update-mode feed that hands on changed keys only.

    Batch n writes its rows to a folder of its own, whole, so a batch that is run again after a failure gives the
    same table, and costs its own keys however many there are in all. Every ``every`` batches the table is folded into one; the
    folder folded from stays until the next fold, so a repeated fold finds it.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], every: int = 20):
        self.spark, self.path, self.keys, self.every = spark, path, list(keys), every

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{self.path}/changes/batch={batch_id}")
        if batch_id and batch_id % self.every == 0:
            before = self._folds(batch_id)
            self._upto(batch_id).write.mode("overwrite").parquet(f"{self.path}/folds/upto={batch_id}")
            for k in before[:-1]:
                drop(self.spark, f"{self.path}/folds/upto={k}")
            for k in self._changes(-1, before[-1] if before else -1):
                drop(self.spark, f"{self.path}/changes/batch={k}")

    def _numbers(self, folder: str) -> list[int]:
        """Numbers of the folders that were written to their end."""
        names = [n for n in list_names(self.spark, f"{self.path}/{folder}") if "=" in n]
        return sorted(int(n.split("=")[1]) for n in names if "_SUCCESS" in list_names(self.spark, f"{self.path}/{folder}/{n}"))

    def _folds(self, below: float) -> list[int]:
        return [k for k in self._numbers("folds") if k < below]

    def _changes(self, above: float, upto: float) -> list[int]:
        return [k for k in self._numbers("changes") if above < k <= upto]

    def _upto(self, batch_id: float) -> DataFrame:
        fold = self._folds(batch_id)[-1:]
        parts = [self.spark.read.parquet(f"{self.path}/folds/upto={k}").withColumn("_batch", F.lit(k).cast("long")) for k in fold]
        parts += [self.spark.read.parquet(f"{self.path}/changes/batch={k}").withColumn("_batch", F.lit(k).cast("long"))
                  for k in self._changes(fold[0] if fold else -1, batch_id)]
        rows = reduce(DataFrame.unionByName, parts)
        columns = [n for n in rows.columns if n != "_batch"]
        newest = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*columns), "_batch").alias("_row"))
        return newest.select(*[F.col(f"_row.{n}").alias(n) for n in columns])

    def current(self) -> DataFrame:
        """One row a key, as of the last batch."""
        return self._upto(float("inf"))


def recent_by_session(
    scored: DataFrame, session: Sequence[str], order: str, size: int = 250, ts: str | None = None, keep: str = "1 hour", late: str = "10 seconds",
    groups: int = SESSION_GROUPS,
) -> DataFrame:
    """Update-mode feed of (session, rows): the newest ``size`` flows of each session that had any, as JSON, newest first.

    The flows are kept in the query's state store, ``size`` a session. Where ``ts`` is given, a session whose
    newest flow is ``keep`` older than the watermark, ``late`` behind the newest of all, is evicted and handed on without rows.

    Sessions are dealt by hash to ``groups`` entries of the store, since each call of Python costs as much as
    thousands of flows. An entry is read and written whole when any session of it has flows, so many millions of sessions need more.
    """
    columns = [n for n in scored.columns if n not in session]
    rows = scored.withWatermark(ts, late) if ts else scored
    when = [F.unix_millis(ts).alias("_ms"), F.col(ts).alias("_ts")] if ts else [F.lit(0).cast("long").alias("_ms")]
    whole = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
    key = F.to_json(F.struct(*session), whole) if session else F.lit("{}")
    wide = rows.select(key.alias("_key"), *when, F.col(order).alias("_order"), F.to_json(F.struct(*columns)).alias("_row"))
    wide = wide.withColumn("_group", F.pmod(F.xxhash64("_key"), F.lit(groups)))
    span = int(pd.Timedelta(keep).total_seconds() * 1000)

    def newest(_: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = json.loads(state.get[0]) if state.exists else {}
        fresh, seen = defaultdict(list), {}
        for part in [] if state.hasTimedOut else parts:
            for k, x, row, ms in zip(part["_key"].tolist(), part["_order"].tolist(), part["_row"].tolist(), part["_ms"].tolist()):
                fresh[k].append((x, row))
                if ts:
                    seen[k] = max(seen.get(k, 0), int(ms))
        out = {}
        for k, flows in fresh.items():
            held, last, _ = known.get(k, ([], 0, 0))
            held, last = heapq.nlargest(size, [*map(tuple, held), *flows]), max(last, seen.get(k, 0))
            known[k] = held, last, max(last + span, state.getCurrentWatermarkMs() + 1) if ts else 0
            out[k] = [r for _, r in held]
        if ts:
            for k in [k for k, (_, _, due) in known.items() if k not in fresh and due < state.getCurrentWatermarkMs()]:
                del known[k]
                out[k] = []
        if known:
            state.update((json.dumps(known),))
            if ts:
                state.setTimeoutTimestamp(min(due for _, _, due in known.values()))
        else:
            state.remove()
        yield pd.DataFrame({"_key": list(out), "rows": list(out.values())})

    timeout = GroupStateTimeout.EventTimeTimeout if ts else GroupStateTimeout.NoTimeout
    found = wide.groupBy("_group").applyInPandasWithState(newest, "_key string, rows array<string>", "held string", "update", timeout)
    schema = T.StructType([scored.schema[n] for n in session])
    return found.select(F.from_json("_key", schema, whole).alias("_key"), "rows").select(*[F.col("_key")[n].alias(n) for n in session], "rows")


def recent_rows(latest: LatestByKey, schema: str) -> DataFrame:
    """The flows that ``recent_by_session`` keeps, one row each; ``schema`` is that of the flows without the session."""
    rows = latest.current().select(*latest.keys, F.explode("rows").alias("_json"))
    return rows.select(*latest.keys, F.from_json("_json", schema).alias("_row")).select(*latest.keys, "_row.*")


class RecentFlows:
    """The newest flows across micro-batches, as a table per batch in shared storage.

    Batch ``n`` merges the table of the batch before with its rows and writes table
    ``n`` whole, so a batch that is run again after a failure gives the same table.
    """

    def __init__(self, spark: SparkSession, path: str, order: str, size: int = 250):
        self.spark, self.path, self.order, self.size = spark, path, order, size

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        before = self._newest(batch_id)
        rows = batch if before is None else before.unionByName(batch)
        newest = rows.orderBy(F.desc(self.order)).limit(self.size)
        newest.write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")

    def _newest(self, below: float = float("inf")) -> DataFrame | None:
        ids = [int(n.split("=")[1]) for n in list_names(self.spark, self.path) if n.startswith("batch=")]
        ids = [i for i in ids if i < below]
        return self.spark.read.parquet(f"{self.path}/batch={max(ids)}") if ids else None

    def current(self) -> DataFrame:
        """The buffer after the last batch, newest first."""
        return self._newest().orderBy(F.desc(self.order))

    def latest_attacks(self, limit: int = 5) -> DataFrame:
        return self.current().where("is_attack").orderBy(F.desc(self.order)).limit(limit)


def batch_sink(path: str) -> Callable[[DataFrame, int], None]:
    """Write each scored batch to its own folder, whole, so a repeat is harmless."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def drift_sink(reference: DataFrame | ValueHistogram, features: Sequence[str], path: str, **thresholds) -> Callable[[DataFrame, int], None]:
    """Drift verdict of every arriving batch against a reference.

    The reference is counted once, when the sink is made, or comes as a kept histogram. A batch is read
    once and merged with it.
    """
    known = reference if isinstance(reference, ValueHistogram) else value_histogram(reference, features)

    def check(batch: DataFrame, batch_id: int) -> None:
        verdict = detect_drift(known, value_histogram(batch, features), features, **thresholds)["verdict"]
        verdict.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return check


def drain(writer, spark: SparkSession) -> StreamingQuery:
    """Run a feed over everything available and stop; the checkpoint is in shared storage."""
    query = writer.option("checkpointLocation", shared_dir(spark, "checkpoint")).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def drain_from(writer, mark: str) -> None:
    """Run a feed over what is available since the checkpoint ``mark`` and stop; a restart goes on there."""
    writer.option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination()


def drain_to_batches(feed: DataFrame, handler: Callable[[DataFrame, int], None]) -> None:
    drain(feed.writeStream.foreachBatch(handler), feed.sparkSession)


def drain_complete(aggregated: DataFrame) -> DataFrame:
    """Final state of a complete-mode aggregation, from a table written by the last batch."""
    spark = aggregated.sparkSession
    path = shared_dir(spark, "totals")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    drain(aggregated.writeStream.outputMode("complete").foreachBatch(write), spark)
    ids = [int(n.split("=")[1]) for n in list_names(spark, path) if n.startswith("batch=")]
    return spark.read.parquet(f"{path}/batch={max(ids)}")


def running_totals(scored: DataFrame, position: str, truth: str = "truth", parts: int | None = None) -> DataFrame:
    """Session totals after every row, in batch form; ``position`` is a unique key of any type.

    The rows are dealt to ordered ranges, however the positions are spread, so no task holds the whole session.
    """
    from ..operators.prefix import ordered_parts, prefix_sums

    known = F.col(truth).isNotNull()
    flags = {
        "_flow": F.lit(1).cast("long"),
        "_attack": F.col("is_attack").cast("long"),
        "_labelled": known.cast("long"),
        "_correct": F.coalesce((F.col(truth) == F.col("prediction")).cast("long"), F.lit(0)),
    }
    rows = scored.select(position, *[v.alias(k) for k, v in flags.items()])
    sums = {"flows": "_flow", "attacks": "_attack", "labelled": "_labelled", "correct": "_correct"}
    totals = prefix_sums(ordered_parts(rows, [position], parts), [], "_part", [position], sums)
    return totals.select(
        position, "flows", "attacks", "labelled", "correct",
        ratio(F.col("attacks"), F.col("flows")).alias("attack_rate"),
        F.when(F.col("labelled") > 0, F.try_divide("correct", "labelled")).alias("accuracy"),
    )

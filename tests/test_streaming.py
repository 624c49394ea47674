import pytest
from pyspark.sql import functions as F

from tidewatch.sources import flows as sources
from tidewatch.streaming import feed

PROBS = {"BENIGN": [0.9] + [0.1 / 7] * 7, "DDoS": [0.1 / 7] * 2 + [0.9] + [0.1 / 7] * 5, "PortScan": [0.1 / 7] * 3 + [0.9] + [0.1 / 7] * 4}


@pytest.fixture()
def folder(spark, tmp_path):
    """Four files of ten flows, one flow a second."""
    kinds = list(PROBS)
    for k in range(4):
        rows = [(i, 1_700_000_000 + i, PROBS[kinds[i % 3]], kinds[i % 3] if i % 5 else None, float(i if k < 2 else i + 100)) for i in range(k * 10, k * 10 + 10)]
        spark.createDataFrame(rows, "id long, sec long, probs array<double>, truth string, x double").select(
            "id", F.timestamp_seconds("sec").alias("ts"), "probs", "truth", "x").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return str(tmp_path / "in")


def scored(spark, folder, per_trigger=1):
    schema = spark.read.parquet(folder).schema
    return feed.score_feed(sources.read_feed(spark, folder, schema, per_trigger))


def test_stream_equals_batch(spark, folder):
    batch = feed.session_stats(feed.score_feed(spark.read.parquet(folder))).first()
    stream = feed.drain_complete(feed.session_stats(scored(spark, folder))).first()
    assert stream.asDict() == batch.asDict()
    assert stream["flows"] == 40 and stream["labelled"] == 32 and stream["accuracy"] == 1.0 and stream["threat_level"] == "HIGH"
    assert sum(stream["by_class"].values()) == 40
    last = feed.running_totals(feed.score_feed(spark.read.parquet(folder)), "id").orderBy(F.desc("id")).first()
    assert (last["flows"], last["attacks"], last["labelled"]) == (stream["flows"], stream["attacks"], stream["labelled"])


def test_recent_flows_across_batches(spark, folder, tmp_path):
    keeper = feed.RecentFlows(spark, str(tmp_path / "recent"), "id", size=13)
    feed.drain_to_batches(scored(spark, folder).select("id", "is_attack"), keeper)
    assert [r["id"] for r in keeper.current().collect()] == list(range(39, 26, -1))
    attacks = keeper.latest_attacks().collect()
    assert len(attacks) == 5 and all(r["is_attack"] for r in attacks)
    keeper(spark.createDataFrame([(99, True)], "id long, is_attack boolean"), 3)
    assert keeper.current().first()["id"] == 99  # the same batch again replaces its table


def test_resume_from_checkpoint(spark, folder, tmp_path):
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")

    def run():
        q = scored(spark, folder).select("id").writeStream.option("checkpointLocation", mark).trigger(availableNow=True).foreachBatch(feed.batch_sink(out)).start()
        q.awaitTermination()

    run()
    spark.createDataFrame([(1000, None, PROBS["DDoS"], None, 0.0)], spark.read.parquet(folder).schema).write.mode("append").parquet(folder)
    run()
    ids = [r["id"] for r in spark.read.parquet(out).select("id").collect()]
    assert sorted(ids) == [*range(40), 1000]


def test_timeline_and_trim(spark, folder):
    rows = feed.score_feed(spark.read.parquet(folder))
    counts = feed.timeline(rows)
    assert counts.count() == 40 and counts.agg(F.sum(F.col("benign") + F.col("attacks"))).first()[0] == 40
    kept = feed.trim_timeline(counts, 5).collect()
    assert len(kept) == 5 and max(r["bucket"] for r in kept).timestamp() == 1_700_000_038
    assert feed.trim_timeline(counts.orderBy("bucket").limit(2)).count() == 2
    stream = feed.drain_complete(feed.timeline(scored(spark, folder)))
    assert stream.count() == 40


def test_drift_of_each_batch(spark, folder, tmp_path):
    reference = spark.read.parquet(folder).where("id < 20").select("x")
    path = str(tmp_path / "drift")
    feed.drain_to_batches(scored(spark, folder, 2).select("x"), feed.drift_sink(reference, ["x"], path))
    got = [r["drift_detected"] for r in spark.read.parquet(path).orderBy("batch").collect()]
    assert len(got) == 2 and got.count(True) == 1


def test_only_changed_keys_are_written_and_folds_keep_the_table(spark, tmp_path):
    """Update mode: batch k holds its own users; a batch run again, also at a fold, gives the same table; folded folders go."""
    table = feed.LatestByKey(spark, str(tmp_path / "latest"), ["user"], every=2)
    shape = "user string, n long"
    want = {}
    for k, rows in enumerate([[("a", 1), ("b", 1)], [("b", 2)], [("c", 1), ("a", 5)], [(None, 4)], [("b", 9)], [("d", 1)], [("a", 7)]]):
        want |= dict(rows)
        for _ in range(2 if k in (2, 4) else 1):
            table(spark.createDataFrame(rows, shape), k)
            assert {r["user"]: r["n"] for r in table.current().collect()} == want
    assert table._numbers("folds") == [4, 6] and table._numbers("changes") == [5, 6]
    assert spark.read.parquet(str(tmp_path / "latest/changes/batch=5")).count() == 1


def test_recent_flows_of_two_sessions_with_eviction_and_restart(spark, tmp_path):
    """Each session keeps its newest flows over a restart; one without flows for ten seconds is evicted."""
    folder, mark = str(tmp_path / "in"), str(tmp_path / "mark")
    shape = "session string, id long, ts timestamp, is_attack boolean"

    def arrive(rows):
        spark.createDataFrame([(s, i, t, i % 2 == 0) for s, i, t in rows], "session string, id long, t long, is_attack boolean").select(
            "session", "id", F.timestamp_seconds("t").alias("ts"), "is_attack").coalesce(1).write.mode("append").parquet(folder)

    table = feed.LatestByKey(spark, str(tmp_path / "latest"), ["session"])

    def run():
        stream = feed.recent_by_session(sources.read_feed(spark, folder, spark.createDataFrame([], shape).schema), ["session"], "id", 3, "ts", "10 seconds", "0 seconds")
        feed.drain_from(stream.writeStream.outputMode("update").foreachBatch(table), mark)
        rows = feed.recent_rows(table, "id long, is_attack boolean").collect()
        return {s: sorted((r["id"] for r in rows if r["session"] == s), reverse=True) for s in {r["session"] for r in rows}}

    arrive([("a", i, 100 + i) for i in range(5)] + [("b", 50 + i, 100) for i in range(2)])
    assert run() == {"a": [4, 3, 2], "b": [51, 50]}
    arrive([("a", 9, 112)])  # b's newest flow is now twelve seconds behind
    arrive([("a", 8, 113)])
    assert run() == {"a": [9, 8, 4]}
    arrive([("b", 60, 114)])
    assert run() == {"a": [9, 8, 4], "b": [60]}


def test_sessions_that_share_an_entry_of_the_state_are_kept_and_evicted_apart(spark, tmp_path):
    """All sessions in one entry, two keys of which one is null or has microseconds; after a restart, too."""
    folder, mark = str(tmp_path / "in"), str(tmp_path / "mark")
    big, now = 2**60 + 1, "2024-01-01 00:00:00.123456"
    a, b, none = (big, now), (big + 1, now), (None, None)

    def arrive(rows):
        spark.createDataFrame([(*s, i, t) for s, i, t in rows], "user long, began string, id long, t long").select(
            "user", F.to_timestamp("began").alias("began"), "id", F.timestamp_seconds("t").alias("ts")).coalesce(1).write.mode("append").parquet(folder)

    batches = []

    def run():
        rows = sources.read_feed(spark, folder, spark.read.parquet(folder).schema)
        stream = feed.recent_by_session(rows, ["user", "began"], "id", 2, "ts", "10 seconds", "0 seconds", groups=1)
        assert stream.dtypes == [("user", "bigint"), ("began", "timestamp"), ("rows", "array<string>")]

        def keep(batch, _):
            flat = batch.select("user", F.col("began").cast("string"), F.transform("rows", lambda r: F.get_json_object(r, "$.id").cast("int")).alias("ids"))
            if got := {(r[0], r[1]): r[2] for r in flat.collect()}:
                batches.append(got)

        feed.drain_from(stream.writeStream.outputMode("update").foreachBatch(keep), mark)

    arrive([(a, i, 100) for i in range(4)] + [(b, 7, 101), (none, 8, 108), (none, 9, 108)])
    run()
    assert batches == [{a: [3, 2], b: [7], none: [9, 8]}]
    arrive([(a, 1, 112)])  # b has had no flow for eleven seconds, and a's newest flows stay
    run()
    assert batches[1:] == [{a: [3, 2]}, {b: []}]
    arrive([(b, 5, 113)])
    run()
    assert batches[3:] == [{b: [5]}]

"""Streams give the batch answers."""

import datetime
import random

from sessionloom.streaming import pairing, sessions


def run(spark, df, name, mode="complete"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return sorted(map(tuple, spark.table(name).collect()), key=str)


def test_batch_equality(spark, tmp_path):
    rows = [(1, f"2026-01-01 00:{m:02d}:00", "a") for m in (0, 10, 45)] + [(2, "2026-01-01 03:00:00", "b")]
    df = spark.createDataFrame(rows, "user_id long, ts string, event_type string").selectExpr("user_id", "cast(ts as timestamp) ts", "event_type")
    df.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    for f in (sessions.gap_sessions, sessions.tumbling_counts):
        assert run(spark, f(stream), f.__name__) == sorted(map(tuple, f(df).collect()), key=str)
    assert len(sessions.gap_sessions(df).collect()) == 3
    assert len(run(spark, sessions.first_of(stream, "event_type"), "once", "append")) == 2


EVENTS = "session_key string, call_id string, ts timestamp, evt long, is_call boolean, payload string"


def test_pairs_of_a_stream_are_those_of_the_batch(spark, tmp_path):
    """Rows in any order within the watermark, over several batches; a late one is dropped and counted; a call without result is forgotten."""
    rng = random.Random(3)
    start = datetime.datetime(2026, 1, 1)
    rows = []
    for s in range(4):
        for evt in range(80):
            rows.append((f"s{s}", f"c{rng.randrange(4)}", start + datetime.timedelta(minutes=evt, seconds=s), evt, rng.random() < 0.5, f"{s}/{evt}"))
    want = sorted(map(tuple, pairing.pairs(spark.createDataFrame(rows, EVENTS)).collect()))
    assert len(want) > 40
    rows.sort(key=lambda r: r[3] + rng.uniform(0, 25))  # at most 25 minutes out of order
    rows.append(("end", "x", start + datetime.timedelta(days=3), 1, True, "moves the watermark"))
    late = [("s0", "c0", start, 0, True, "too late")]
    rows_by_file = [rows[i : i + 60] for i in range(0, len(rows), 60)] + [late, [("end", "y", start + datetime.timedelta(days=9), 2, True, "ends it")]]
    schema = spark.createDataFrame([], EVENTS).schema
    source = tmp_path / "in"
    source.mkdir()
    stream = pairing.pairs(spark.readStream.schema(schema).parquet(str(source)), late="30 minutes")
    q = stream.writeStream.format("memory").queryName("paired").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    for k, part in enumerate(rows_by_file):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / f"made{k}"))
        for f in sorted((tmp_path / f"made{k}").glob("*.parquet")):
            f.rename(source / f"{k}.parquet")
        q.processAllAvailable()
    got = sorted(map(tuple, spark.table("paired").collect()))
    dropped = pairing.late_rows(q)
    q.stop()
    assert got == want and dropped == 1

"""Streaming operators over files that arrive one by one, against their batch twins."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from folioscope.operators import runlog, scheduling
from folioscope.streaming import operators as streaming

T0 = dt.datetime(2024, 1, 1)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


@pytest.fixture
def streamed(spark, tmp_path):
    """Runs a streaming operator over parts of a table, each a batch of its own, and returns all rows it gave out."""

    def run(parts, schema, operator, mode):
        folder = tmp_path / "in"
        for i, part in enumerate(parts):
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{folder}/{i:03}")
        kind = spark.createDataFrame([], schema).schema
        source = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")
        out = []
        query = (
            operator(source)
            .writeStream.outputMode(mode)
            .option("checkpointLocation", f"{tmp_path}/state")
            .foreachBatch(lambda df, _: out.extend(map(tuple, df.collect())))
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination(240)
        assert query.exception() is None
        return out

    return run


def split(rows, n):
    size = -(-len(rows) // n)
    return [rows[i : i + size] for i in range(0, len(rows), size)]


REQUESTS = "client long, request_id long, ts timestamp"


def test_rate_windows(spark, streamed):
    rnd = random.Random(1)
    rows = sorted((rnd.randrange(2), i, at(rnd.randrange(400))) for i in range(60))
    rows.sort(key=lambda r: r[2])
    late = [(0, 900, at(1))]  # behind the watermark by then: left out
    got = streamed([*split(rows, 3), [(9, 99, at(5000))], late, [(9, 98, at(9000))]], REQUESTS, lambda s: streaming.rate_windows(s, 3), "append")
    want = scheduling.rate_windows(spark.createDataFrame(rows, REQUESTS), 3).collect()
    assert sorted(r for r in got if r[0] != 9) == sorted(map(tuple, want))


def test_open_calls(spark, streamed):
    rnd = random.Random(4)
    kinds = ["model_call_start", "model_call_start", "model_call"]
    rows = [(rnd.choice(["s", "t"]), i, at(i), rnd.choice(kinds), rnd.choice(["a", "b", None]), "m", None) for i in range(60)]
    schema = "session_id string, line long, ts timestamp, type string, agent string, model string, capability string"
    got = streamed(split(rows, 4), schema, streaming.in_flight, "update")
    last = {r[0]: r[1:] for r in got}
    exact = runlog.in_flight_exact(spark.createDataFrame(rows, schema)).collect()
    for session in ("s", "t"):
        own = sorted((r for r in exact if r.session_id == session), key=lambda r: (r.ts, r.line))
        assert last[session] == (len(own), own[0].key)


CHUNKS = "call_id string, seq long, ts timestamp, kind string, text_length int"


def test_stalls(streamed):
    one = [("fine", 0, at(0), "text", 1), ("quiet", 1, at(0), "protocol", 0), ("idle", 2, at(0), "text", 2)]
    two = [("fine", 3, at(50), "text", 1), ("idle", 4, at(40), "keepalive", 0), ("idle", 5, at(70), "text", 1), ("fine", 6, at(100), "done", 0)]
    three = [("other", 7, at(2000), "text", 1)]
    got = streamed([one, two, three, [("other", 8, at(2010), "text", 1)]], CHUNKS, streaming.stalls, "append")
    assert ("idle", "idle") in got and ("quiet", "first_output") in got
    assert len([r for r in got if r[0] == "idle"]) == 1


def test_idle_islands(spark, streamed):
    rows = [("c", i, at(s), "text", 1) for i, s in enumerate([0, 30, 59, 200, 210])] + [("c", 9, at(100), "keepalive", 0)]
    got = streamed([rows, [("z", 10, at(9000), "text", 1)], [("z", 11, at(9001), "text", 1)]], CHUNKS, streaming.idle_sessions, "append")
    assert sorted((r[0], r[3]) for r in got) == [("c", 2), ("c", 3)]


def test_token_cache(spark, streamed):
    rows = [(c, 10 * c + i, at(s)) for c in (1, 2) for i, s in enumerate([0, 100, 299, 300, 500, 900])]
    rows.sort(key=lambda r: r[2])
    got = streamed(split(rows, 3), REQUESTS, streaming.token_cache, "append")
    want = scheduling.token_cache(spark.createDataFrame(rows, REQUESTS)).collect()
    assert sorted(got) == sorted(map(tuple, want))


def test_session_timestamps_keep_their_zone(spark):
    assert spark.createDataFrame([(at(0),)], "ts timestamp").select(F.unix_seconds("ts")).first()[0] == 1704067200

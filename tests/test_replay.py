"""The limiter equals a plain loop, in batches and in streams; contexts equal slices."""

from datetime import datetime, timedelta

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from claimsift.operators import context, lookup, replay
from claimsift.streaming import limiter

START = datetime(2024, 1, 1)
SCHEMA = "id long, user string, at timestamp"


def loop(events, limit, period):
    held, out = {}, {}
    for number, user, at in sorted(events, key=lambda e: (e[2], e[0])):
        recent = [t for t in held.get(user, []) if (at - t).total_seconds() < period]
        out[number] = len(recent) < limit
        if out[number]:
            recent.append(at)
        held[user] = recent
    return out


def events_of(raw):
    return [(i, u, START + timedelta(seconds=s)) for i, (u, s) in enumerate(raw)]


USERS = st.one_of(st.none(), st.sampled_from(["a", "b"]))


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(USERS, st.integers(0, 400)), max_size=60), st.integers(1, 4), st.integers(5, 90))
def test_replay_equals_loop(spark, raw, limit, period):
    events = events_of(raw)
    df = spark.createDataFrame(events, SCHEMA)
    got = {r.id: r.allowed for r in replay.rate_limit_replay(df, ["user"], "at", "id", limit, period).collect()}
    assert got == loop(events, limit, period)


def test_a_segment_may_span_frames_and_slots_may_be_hot(spark, monkeypatch):
    monkeypatch.setattr(lookup, "HOT_ROWS", 20)
    monkeypatch.setattr(replay, "FOLD_ROWS", 0)
    raw = [("a" if i % 3 else "b", (i * 37) % 5000 // 7) for i in range(1500)]
    events = events_of(raw)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "13")
    try:
        df = spark.createDataFrame(events, SCHEMA)
        got = {r.id: r.allowed for r in replay.rate_limit_replay(df, ["user"], "at", "id", 3, 60).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == loop(events, 3, 60)


@pytest.mark.parametrize("bound", [0, 5, 40, 1000])
def test_short_segments_need_no_python_worker(spark, monkeypatch, bound):
    """Bursts of 1 to 60 events; those beyond the bound go through a worker, with equal answers."""
    monkeypatch.setattr(replay, "FOLD_ROWS", bound)
    raw = [(u, 1000 * n + (7 * i) % 50) for u in ("a", "b", None) for n, size in enumerate([1, 4, 6, 35, 60]) for i in range(size)]
    events = events_of(raw)
    judged = replay.rate_limit_replay(spark.createDataFrame(events, SCHEMA), ["user"], "at", "id", 3, 60)
    assert judged.columns == ["id", "user", "at", "allowed"]
    assert {r.id: r.allowed for r in judged.collect()} == loop(events, 3, 60)
    assert ("MapInPandas" in judged._jdf.queryExecution().optimizedPlan().toString()) == (bound < 60)


def test_events_with_columns_that_cannot_be_ordered(spark):
    events = events_of([("a", s) for s in (0, 1, 2, 70)])
    df = spark.createDataFrame(events, SCHEMA).withColumn("more", F.create_map(F.lit("k"), F.col("id")))
    got = replay.rate_limit_replay(df, ["user"], "at", "id", 2, 60).collect()
    assert {r.id: r.allowed for r in got} == loop(events, 2, 60) and all(r.more["k"] == r.id for r in got)
    assert replay.rate_limit_replay(df.where("false"), ["user"], "at", "id", 2, 60).collect() == []


def test_events_without_time_disturb_no_others(spark):
    raw = [("a", s) for s in (0, 1, 2, 3, 100)]
    events = events_of(raw)
    extra = [(10 + i, "a", None) for i in range(3)]
    df = spark.createDataFrame(events + extra, SCHEMA)
    got = {r.id: r.allowed for r in replay.rate_limit_replay(df, ["user"], "at", "id", 2, 60).collect()}
    assert {k: v for k, v in got.items() if k < 10} == loop(events, 2, 60)
    assert [got[k] for k in (10, 11, 12)] == [True, True, False]


def run_limiter(spark, tmp_path, pieces, limit, period, late):
    """Feed pieces one by one, starting the stream anew from its checkpoint each time."""
    arrivals, output, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    schema = spark.createDataFrame([], SCHEMA).schema
    for piece in pieces:
        spark.createDataFrame(piece, SCHEMA).coalesce(1).write.mode("append").parquet(arrivals)
        stream = spark.readStream.schema(schema).parquet(arrivals)
        judged = limiter.limited(stream, ["user"], "at", "id", limit, period, late)
        judged.writeStream.format("parquet").option("checkpointLocation", progress).trigger(availableNow=True).start(output).awaitTermination()
    got = [(r.id, r.allowed) for r in spark.read.parquet(output).collect()]
    assert len(got) == len(dict(got))
    return dict(got), progress


def test_late_events_in_several_runs_equal_the_loop(spark, tmp_path):
    """Arrivals are out of order by up to 50 seconds, also from one run to the next."""
    events = [(i, (None, "a", "a", "b")[i % 4], START + timedelta(seconds=(i * 53) % 900, microseconds=i)) for i in range(300)]
    arriving = sorted(events, key=lambda e: (e[2] + timedelta(seconds=(e[0] * 31) % 50), e[0]))
    flush = (1000, "z", START + timedelta(hours=2))
    untimed = (2000, "a", None)
    pieces = [arriving[:110], arriving[110:200] + [untimed], arriving[200:], [flush]]
    got, progress = run_limiter(spark, tmp_path, pieces, 3, 60, "60 seconds")
    assert got == {**loop(events, 3, 60), 2000: False}
    # What is left: the last event, waiting, and no admitted times of the others.
    held = spark.read.format("statestore").option("stateVarName", "admitted").load(progress)
    assert held.count() == 0


def test_a_crowded_key_keeps_its_limit(spark, tmp_path):
    events = [(i, "a", START + timedelta(milliseconds=10 * i)) for i in range(1200)]
    got, progress = run_limiter(spark, tmp_path, [events[:600], events[600:]], 5, 60, "2 seconds")
    want = loop(events, 5, 60)
    assert len(got) == 999 and all(want[i] == a for i, a in got.items())
    held = spark.read.format("statestore").option("stateVarName", "admitted").load(progress)
    assert held.count() == 5


def test_context_is_the_last_turns_whatever_the_chunk(spark):
    rows = [(c, t, "user" if t % 2 else "assistant", f"{c}/{t}") for c in range(3) for t in range(0, 40, c + 1)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for chunk in (1, 3, 7, 1000):
        got = {(r.conv_id, r.turn): [m.content for m in r.context] for r in context.chat_context(df, chunk=chunk).collect()}
        for c in range(3):
            turns = [t for k, t, _, _ in rows if k == c]
            for i, t in enumerate(turns):
                assert got[c, t] == [f"{c}/{x}" for x in turns[max(0, i - 5) : i + 1]]


def test_rows_without_conversation_or_turn_are_kept(spark):
    rows = [(None, 0, "user", "a"), (None, 1, "user", "b"), (1, None, "user", "c"), (1, 0, "user", "d")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.text: [m.content for m in r.context] for r in context.chat_context(df).collect()}
    assert got == {"a": ["a"], "b": ["a", "b"], "c": ["c"], "d": ["c", "d"]}


def test_roles(spark):
    df = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "bot", "a")], "conv_id long, turn long, role string, text string")
    last = context.chat_context(df).orderBy(F.desc("turn")).first()
    assert [m.role for m in last.context] == ["user", "assistant"]

"""Streams over several micro-batches give what the batch jobs give."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import rows
from memlake.config import MemoryConfig
from memlake.streaming import jobs, processors, state

T0 = dt.datetime(2024, 1, 1)
MIN = dt.timedelta(minutes=1)


def source(spark, tmp_path, batches, schema, name="in"):
    path = str(tmp_path / name)
    for i, b in enumerate(batches):
        spark.createDataFrame(b, schema).coalesce(1).write.parquet(f"{path}/part={i}")
    return (spark.readStream.schema(spark.createDataFrame([], schema).schema).option("maxFilesPerTrigger", 1)
            .option("recursiveFileLookup", "true").parquet(path))


TURN = "conv_id bigint, turn bigint, ts timestamp, text string"


def fragments(spark, tmp_path, batches, gap=30, name="in", **cfg):
    src = source(spark, tmp_path, batches, TURN, name).withWatermark("ts", jobs.WATERMARK)
    return jobs.drain(processors.unclosed_fragments(src, gap, MemoryConfig(**cfg)), str(tmp_path / f"{name}-out"))


def test_gap_closes_a_fragment_across_batches(spark, tmp_path):
    batches = [[(1, 0, T0, "a"), (2, 0, T0, "x")], [(1, 1, T0 + 5 * MIN, "b")], [(1, 2, T0 + 90 * MIN, "c")]]
    out = fragments(spark, tmp_path, batches).filter("closed_by <> 'accepted'")
    assert rows(out, "conv_id", "session_no", "part", "turns", "content", "closed_by") == [(1, 1, 0, 2, "a\nb", "gap")]


def test_a_stale_session_number_is_not_used_again(spark, tmp_path):
    day = 60 * 24 * MIN
    batches = [[(1, 0, T0, "a")], [(2, 0, T0 + 2 * day, "x")], [(2, 1, T0 + 2 * day + MIN, "y")], [(1, 1, T0 + 2 * day, "b")], [(1, 2, T0 + 3 * day, "c")]]
    out = fragments(spark, tmp_path, batches).filter("closed_by <> 'accepted'")
    got = rows(out.filter("conv_id = 1"), "session_no", "content", "closed_by")
    assert got[:2] == [(1, "a", "stale"), (2, "b", "gap")] and out.select("conv_id", "session_no", "part").distinct().count() == out.count()


def test_long_text_is_sealed_in_parts_and_state_stays_small(spark, tmp_path):
    batches = [[(1, i, T0 + i * MIN, "x" * 60) for i in range(k, k + 2)] for k in (0, 2, 4)] + [[(1, 9, T0 + 99 * MIN, None)], [(1, 10, T0 + 199 * MIN, "y" * 400)], [(1, 11, T0 + 299 * MIN, "z")]]
    out = fragments(spark, tmp_path, batches, context_window=3667)  # threshold 99
    got = rows(out.filter("closed_by <> 'accepted'"), "session_no", "part", "turns", "closed_by", "oversized")
    assert got == [(1, i, 1, "force" if i < 5 else "gap", False) for i in range(6)] + [(2, 0, 1, "gap", False), (3, 0, 1, "gap", True)]
    sealed = jobs.sealed_events(out.filter("session_no = 1 and closed_by in ('force', 'gap')"))
    chain = {r.part: (r.event_id, r.split_prefix_event_ids) for r in sealed.collect()}
    assert all(chain[p][1] == [chain[q][0] for q in range(p)] for p in chain) and len({v[0] for v in chain.values()}) == 6


def test_late_turns_are_in_no_accepted_row(spark, tmp_path):
    batches = [[(1, 0, T0, "a")], [(1, 1, T0 + 600 * MIN, "b")], [(2, 0, T0 + 600 * MIN, "x")], [(1, 2, T0 + 5 * MIN, "late"), (2, 1, T0 + 600 * MIN, "x")], [(1, 3, T0 + 601 * MIN, "c")]]
    src = source(spark, tmp_path, batches, TURN)
    jobs.ingest(src, str(tmp_path / "lake")).awaitTermination()
    given = spark.createDataFrame([r for b in batches for r in b], TURN)
    late = jobs.late_rows(given, spark.read.parquet(str(tmp_path / "lake" / "accepted")), ["conv_id", "turn"])
    assert rows(late, "conv_id", "turn") == [(1, 2)]


def test_rolling_affect_in_three_batches_equals_one(spark, tmp_path):
    schema = "role_id string, create_time timestamp, arousal double, valence double"
    data = [("r", T0 + i * 37 * MIN, i / 10, (-1) ** i * i / 20) for i in range(9)]
    ends = []
    for name, parts in (("three", [data[6:], data[:3], data[3:6]]), ("one", [data])):
        src = source(spark, tmp_path, parts, schema, name)
        out = jobs.latest(jobs.drain(state.rolling_affect(src), str(tmp_path / f"{name}-out"), "update"), ["role_id"])
        ends.append(out.first())
    assert ends[0].energy == pytest.approx(ends[1].energy) and ends[0].rolling_valence == pytest.approx(ends[1].rolling_valence)
    assert ends[0].rows == 9


def test_phase_window_keeps_the_newest(spark, tmp_path):
    schema = "phase string, seq bigint, elapsed_ms double"
    src = source(spark, tmp_path, [[("p", i, float(i)) for i in range(k, k + 20)] for k in (0, 20, 40)], schema)
    out = jobs.latest(jobs.drain(processors.perf_window(src), str(tmp_path / "out"), "update"), ["phase"]).first()
    assert out.samples == 32 and out.mean_ms == pytest.approx(sum(range(28, 60)) / 32)


def test_bypass_once_per_minute(spark, tmp_path):
    schema = "source string, query_id string, asked_at timestamp, best_score double"
    ask = lambda i, s, score=0.1: ("s", f"q{i}", T0 + dt.timedelta(seconds=s), score)
    src = source(spark, tmp_path, [[ask(0, 0), ask(1, 30)], [ask(2, 61), ask(3, 100)], [ask(4, 130, 0.9), ask(5, 131)]], schema)
    assert rows(jobs.drain(state.bypass_limit(src), str(tmp_path / "out")), "query_id") == [("q0",), ("q2",), ("q5",)]


def test_quality_signals_keep_their_state(spark, tmp_path):
    schema = "source string, seq bigint, rate_a double, rate_b double"
    src = source(spark, tmp_path, [[("s", 0, 1.0, None)], [("s", 1, 0.0, 0.4)]], schema)
    out = jobs.latest(jobs.drain(state.quality_ema(src), str(tmp_path / "out"), "update"), ["source"]).first()
    assert out.ema_a == pytest.approx(0.75) and out.ema_b == pytest.approx(0.4)


def test_sessions_and_repeats(spark, tmp_path):
    src = source(spark, tmp_path, [[(1, 0, T0, "a")], [(1, 0, T0, "a"), (1, 1, T0 + MIN, "b")]], TURN)
    out = jobs.drain(jobs.dedupe(src, "turn", "ts"), str(tmp_path / "out"))
    assert rows(out, "turn") == [(0,), (1,)]


def test_session_windows_close_behind_the_watermark(spark, tmp_path):
    src = source(spark, tmp_path, [[(1, 0, T0, "a"), (1, 1, T0 + 5 * MIN, "b")], [(1, 2, T0 + 300 * MIN, "c")], [(2, 0, T0 + 600 * MIN, "d")]], TURN)
    out = jobs.drain(jobs.session_counts(src, "ts", "conv_id", "10 minutes"), str(tmp_path / "out"))
    assert (1, 2) in rows(out, "conv_id", "n")


def test_ingest_tables_agree_with_the_batch_sessions(spark, tmp_path):
    from memlake.operators.segment import gap_sessions
    turns = [(c, i, T0 + (i * 11 + (i // 4) * 60 + c) * MIN, f"text {c} {i}.") for i in range(12) for c in range(3)]
    turns.append((9, 0, T0, "left alone"))
    turns.append((8, 0, T0 + 60 * 72 * MIN, "much later"))
    src = source(spark, tmp_path, [turns[:9] + turns[-2:-1], turns[9:20], turns[20:-2], turns[-1:]], TURN)
    jobs.ingest(src, str(tmp_path / "lake")).awaitTermination()
    events, stale, log = (spark.read.parquet(str(tmp_path / "lake" / x)) for x in ("event", "stale", "recall_log"))
    batch = gap_sessions(spark.createDataFrame(turns, TURN), 30).groupBy("conv_id", "session_no").agg(F.count("*").alias("turns"))
    last = batch.groupBy("conv_id").agg(F.max("session_no").alias("last"))
    closed = batch.join(last, "conv_id").filter("session_no < last")
    assert rows(events, "conv_id", "session_no", "turns") == rows(closed, "conv_id", "session_no", "turns")
    assert {r.conv_id for r in stale.collect()} == {0, 1, 2, 9} and 9 not in {r.conv_id for r in events.collect()}
    known = {r.event_id for r in events.collect()}
    lists = [r.event_ids for r in log.collect()]
    assert max(map(len, lists)) > 1 and all(len(set(x)) == len(x) and set(x) <= known for x in lists)


def test_a_restart_between_batches_changes_nothing(spark, tmp_path):
    """Three batches, the query started anew from its checkpoint before the last one, against one uninterrupted run."""
    turns = [(c, i, T0 + (i * 11 + (i // 4) * 60 + c) * MIN, f"text {c} {i}.") for i in range(12) for c in range(3)]
    parts = [turns[:10], turns[10:24], turns[24:]]
    got = {}
    for name in ("whole", "restarted"):
        src = source(spark, tmp_path, parts if name == "whole" else parts[:2], TURN, name)
        jobs.ingest(src, str(tmp_path / f"{name}-lake")).awaitTermination()
        if name == "restarted":
            spark.createDataFrame(parts[2], TURN).coalesce(1).write.parquet(str(tmp_path / name / "part=2"))
            jobs.ingest(src, str(tmp_path / f"{name}-lake")).awaitTermination()
        tables = {x: spark.read.parquet(str(tmp_path / f"{name}-lake" / x)).drop("batch") for x in ("event", "stale", "accepted", "recall_log")}
        # a run ends with a batch without data that lets timers fire, so batch numbers differ
        tables["recall_log"] = tables["recall_log"].withColumn("recall_id", F.substring_index("recall_id", "-", 2))
        got[name] = [rows(df) for df in tables.values()]
    assert got["whole"] == got["restarted"] and all(got["whole"][i] for i in (0, 2, 3))


def test_recall_from_state_equals_recall_from_the_table(spark, tmp_path):
    """The newest sealed events that the state names are those that the event table would give, cut to the same number."""
    from memlake.operators.ordered import first_per_key
    cfg = MemoryConfig(n_results=3)

    def from_table(asked, events, cfg):
        mine = asked.select("query_id", "conv_id").join(events.select("conv_id", "event_id", "create_time", "part"), "conv_id")
        return first_per_key(mine, ["query_id"], [F.col("create_time").desc(), F.col("part").desc()], cfg.n_results, "position")
    turns = [(c, i, T0 + (i * 40 + c) * MIN, f"t{i}") for i in range(12) for c in range(2)]
    logs = []
    for name, recall in (("state", None), ("table", from_table)):
        src = source(spark, tmp_path, [turns[:4], turns[4:14], turns[14:]], TURN, name)
        jobs.ingest(src, str(tmp_path / f"{name}-lake"), cfg=cfg, recall=recall).awaitTermination()
        logs.append(rows(spark.read.parquet(str(tmp_path / f"{name}-lake" / "recall_log")), "recall_id", "event_ids"))
    assert logs[0] == logs[1] and max(len(r[1]) for r in logs[0]) == 3


def test_rows_without_a_time_come_in_the_first_batch(spark, tmp_path):
    given = spark.createDataFrame([(i, None if i % 4 == 0 else i) for i in range(40)], "id long, at long")
    stream = jobs.in_batches(given, F.col("at"), str(tmp_path / "spans"))
    out = jobs.drain(stream, str(tmp_path / "out"))
    assert out.count() == 40 and {r.batch for r in out.filter("at is null").collect()} == {0}
    assert out.groupBy("batch").count().count() == 3


def test_state_is_asked_only_where_it_may_hold_something(monkeypatch):
    """A conversation that comes up first asks for its counters alone; one that seals its held text writes the list once."""
    calls = []

    class Kept:
        def __init__(self, name, value=None):
            self.name, self.value = name, value

        def __getattr__(self, what):
            def call(*args):
                calls.append(f"{self.name}.{what}")
                return self.value if what in ("get", "iterator") else []
            return call

    p = processors.Fragments(30, MemoryConfig(), 5)
    turn = processors.Row("conv_id", "turn", "ts", "text")
    mark = type("Timer", (), {"getCurrentWatermarkInMs": lambda self: 0})()
    p.handle, p.open, p.texts, p.sealed = Kept("handle"), Kept("open"), Kept("texts"), Kept("sealed")
    first = list(p.handleInputRows((1,), iter([turn(1, 1, T0 + MIN, "b"), turn(1, 0, T0, "a")]), mark))
    assert calls == ["open.get", "texts.appendList", "open.update", "handle.registerTimer"] and first[0].accepted == [0, 1]
    calls.clear()
    at = int((T0 - dt.datetime(1970, 1, 1)).total_seconds()) * 10 ** 6
    p.open, p.texts, p.sealed = Kept("open", (1, 0, 1, 1, at, at)), Kept("texts", [("a",)]), Kept("sealed", [])
    rest = list(p.handleInputRows((1,), iter([turn(1, 1, T0 + 90 * MIN, "b")]), mark))
    assert [r.closed_by for r in rest] == ["gap", "accepted"] and "texts.put" in calls and "texts.clear" not in calls and "open.exists" not in calls


def test_rolling_affect_takes_times_as_numbers_and_passes_over_nulls(spark, tmp_path):
    import math
    schema = "role_id string, create_time timestamp, arousal double, valence double"
    data = [("r", T0, 0.5, None), ("r", T0 + 60 * MIN, None, 0.4), ("r", T0 + 120 * MIN, 0.2, -0.3)]
    stream = state.rolling_affect(source(spark, tmp_path, [data], schema))
    assert "unix_micros" in stream._jdf.queryExecution().analyzed().toString()
    out = jobs.drain(stream, str(tmp_path / "out"), "update").first()
    w = [math.exp(-0.2), math.exp(-0.1), 1.0]
    assert out.rows == 3 and out.energy == pytest.approx(0.5 * w[0] + 0.2)
    assert out.rolling_valence == pytest.approx((0.4 * w[1] - 0.3) / sum(w))

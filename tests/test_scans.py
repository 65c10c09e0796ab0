"""Recurrences over slots against a plain loop."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from memlake.operators import monitor, scans, timeline as tl

SCHEMA = "k string, at long, id string, a double, b double, s double"


def plain(rows):
    out, y = {}, {}
    for k, at, i, a, b, s in sorted(rows, key=lambda r: (r[0] or "", r[1], r[2])):
        before = y.get(k, s)
        y[k] = (1.0 if a is None else a) * before + (0.0 if b is None else b)
        out[k, i] = y[k]
    return out


def rows_of(n=600):
    rng = np.random.default_rng(4)
    hot = lambda i: ["hot", "hot", "b", "c", None][i % 5]
    return [(hot(i), int(rng.integers(0, 50)), f"i{i:04d}", None if i % 31 == 0 else float(rng.uniform(-1, 1)), float(rng.normal()), float(i % 7)) for i in range(n)]


@pytest.mark.parametrize("per_slot", [37, 250, 10_000])
def test_affine_equals_a_plain_loop(spark, per_slot):
    data = rows_of()
    got = scans.affine(spark.createDataFrame(data, SCHEMA), ["k"], ["at", "id"], F.col("a"), F.col("b"), "y", start=F.col("s"), rows_per_slot=per_slot)
    assert got.columns == ["k", "at", "id", "a", "b", "s", "y"]
    have = {(r.k, r.id): r.y for r in got.collect()}
    want = plain(data)
    assert have.keys() == want.keys() and all(have[x] == pytest.approx(want[x], abs=1e-9) for x in want)


def test_affine_of_nothing_and_of_one_row(spark):
    df = spark.createDataFrame([("k", 1, "i", 0.5, 2.0, 4.0)], SCHEMA)
    assert scans.affine(df, ["k"], ["at", "id"], F.col("a"), F.col("b"), "y", start=F.col("s")).first().y == 4.0
    assert scans.affine(df, ["k"], ["at", "id"], F.col("a"), F.col("b"), "y").first().y == 2.0
    assert scans.affine(df.limit(0), ["k"], ["at", "id"], F.col("a"), F.col("b"), "y").count() == 0


def test_means_build_no_lists(spark):
    df = spark.createDataFrame([("s", i, i / 10) for i in range(20)], "source string, seq long, rate double")
    out = monitor.quality_ema(df, "source", ["seq"], "rate", "ema")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "array<" not in out.schema.simpleString()
    y = None
    for r in sorted(out.collect(), key=lambda r: r.seq):
        rate = min(r.seq / 10, 1.0)
        y = rate if y is None else 0.25 * rate + 0.75 * y
        assert r.ema == pytest.approx(y)


def test_energy_in_slots_and_silence_by_rank(spark, sf):
    from memlake.mappings import Tables
    t = Tables(spark, sf)
    one, many = ({(r.role_id, r.event_id): r for r in tl.accumulated_energy(t.timeline, rows_per_slot=n).collect()} for n in (10 ** 6, 300))
    assert one.keys() == many.keys() and one
    for k in one:
        for x, y in zip(one[k], many[k]):
            assert x == (pytest.approx(y) if isinstance(y, float) else y)
    placed = sorted(tl.capacity_silence(t.timeline, t.as_of, F.lit(2.0)).collect(), key=lambda r: (-r.effective, r.role_id, r.event_id))
    assert [r.place for r in placed] == list(range(1, len(placed) + 1))
    assert sum(not r.is_silent for r in placed) == int(len(placed) * (0.6 - 0.2 / 3))

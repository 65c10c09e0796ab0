"""Pipeline health: phase timings, load, quality signals, call statistics, probes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from memlake.config import (ABSTRACT_PHASES, DEFAULT, DEFAULT_PHASE_LIMIT_MS, PHASE_LIMIT_MS,
                            RECALL_PHASES, MemoryConfig)
from memlake.functions import scoring
from memlake.operators.ordered import SLOT, first_per_key, row_position, with_preceding
from memlake.operators.scans import affine


def audit_schedule(events: DataFrame, source: str, cfg: MemoryConfig = DEFAULT) -> DataFrame:
    """Every N-th ingest of a source."""
    placed = row_position(events, [source], [F.col("create_time"), F.col("event_id")], "seq")
    return placed.filter(F.col("seq") % cfg.audit_every == 0)


def phase_limit(phase: Column) -> Column:
    out = F.lit(DEFAULT_PHASE_LIMIT_MS)
    for name, ms in PHASE_LIMIT_MS.items():
        out = F.when(phase == name, ms).otherwise(out)
    return out


def perf_rolling_mean(samples: DataFrame, cfg: MemoryConfig = DEFAULT) -> DataFrame:
    """Mean of the last 32 samples at every sample; each phase may be hot, so it is slotted."""
    n = cfg.perf_window
    src = samples.select("phase", "seq", "elapsed_ms")
    frame = Window.partitionBy("phase", SLOT).orderBy("seq").rowsBetween(1 - n, 0)
    return (
        with_preceding(src, ["phase"], ["seq"], n - 1)
        .withColumn("mean_ms", F.avg("elapsed_ms").over(frame)).filter(~F.col("_carried"))
        .select("phase", "seq", "mean_ms", (F.col("mean_ms") / phase_limit(F.col("phase"))).alias("overload")))


def phase_state(samples: DataFrame, cfg: MemoryConfig = DEFAULT) -> DataFrame:
    """Current mean and overload of each phase, from its newest samples only."""
    last = first_per_key(samples, ["phase"], [F.col("seq").desc()], cfg.perf_window)
    return last.groupBy("phase").agg(F.avg("elapsed_ms").alias("mean_ms")).withColumn(
        "overload", F.col("mean_ms") / phase_limit(F.col("phase")))


def load_factors(samples: DataFrame, cfg: MemoryConfig = DEFAULT) -> DataFrame:
    """Load of the recall and abstract channels and of everything, each in [1, load_max]."""
    state = phase_state(samples, cfg)
    of = lambda names: F.max(F.when(F.col("phase").isin(*names), F.col("overload")))
    return state.agg(
        scoring.load_of(F.max("overload"), cfg).alias("load_global"),
        scoring.load_of(of(RECALL_PHASES), cfg).alias("load_recall"),
        scoring.load_of(of(ABSTRACT_PHASES), cfg).alias("load_abstract"))


def load_limits(samples: DataFrame, cfg: MemoryConfig = DEFAULT) -> DataFrame:
    """Pool and mining windows under the current load."""
    return load_factors(samples, cfg).select(
        "load_recall", "load_abstract", "load_global",
        scoring.adjusted_limit(F.lit(cfg.pool_base), F.lit(cfg.pool_min), F.col("load_recall"), cfg).alias("pool_limit"),
        scoring.adjusted_limit(F.lit(cfg.recent_k), F.lit(cfg.min_recent_k), F.col("load_abstract"), cfg).alias("recent_k"),
        scoring.adjusted_limit(F.lit(cfg.dup_recent_k), F.lit(cfg.dup_min_recent_k), F.col("load_global"), cfg).alias("dup_recent_k"))


def quality_ema(rates: DataFrame, key: str, order: list[str], rate: str, out: str,
                cfg: MemoryConfig = DEFAULT) -> DataFrame:
    """Exponential mean of a rate per source, at every row; the first row's rate is the start."""
    a = min(max(cfg.ema_alpha, 1e-6), 1.0)
    src = rates.select(key, *order, F.least(F.greatest(F.col(rate), F.lit(0.0)), F.lit(1.0)).alias("_r"))
    return affine(src, [key], order, F.lit(1 - a), F.lit(a) * F.col("_r"), out, start=F.col("_r")).drop("_r")


def invocation_stats(calls: DataFrame) -> DataFrame:
    """Calls, latency and tokens by task and model with totals."""
    return calls.rollup("task_type", "model").agg(
        F.count("*").alias("calls"), F.avg("latency_ms").alias("mean_ms"), F.min("latency_ms").alias("min_ms"),
        F.max("latency_ms").alias("max_ms"), F.sum("prompt_tokens").alias("prompt_tokens"),
        F.sum("completion_tokens").alias("completion_tokens"))


def trace_summary(trace: DataFrame) -> DataFrame:
    """Per pipeline step: runs, time, calls and tokens."""
    return trace.groupBy("step").agg(
        F.count_distinct("run_id").alias("runs"), F.sum("elapsed_ms").alias("elapsed_ms"),
        F.sum("calls").alias("calls"), F.sum("tokens").alias("tokens"))


def recall_trace(hits: DataFrame, top: int = 20) -> DataFrame:
    """Per query: hits per route, weights, nearest distance and the first hits."""
    per = hits.groupBy("query_id").agg(
        F.count("*").alias("hits"), F.count_if(F.col("route") == 0).alias("route0"),
        F.count_if(F.col("route") == 1).alias("route1"), F.count_if(F.col("route") == 2).alias("route2"),
        F.max("weight").alias("max_weight"), F.min("distance").alias("min_distance"))
    first = first_per_key(hits, ["query_id"], [F.col("distance"), F.col("event_id")], top)
    ids = F.array_sort(F.collect_list(F.struct("rn", "event_id")))
    best = first.groupBy("query_id").agg(F.array_join(F.transform(ids, lambda s: s["event_id"]), "|").alias("top_ids"))
    return per.join(best, "query_id")


def probe(df: DataFrame, name: str, bad: Column) -> DataFrame:
    """One rule as a row: how many rows were looked at and how many break it."""
    return df.agg(F.count("*").alias("rows"), F.count_if(bad).alias("broken")).select(
        F.lit(name).alias("probe"), "rows", "broken",
        F.when(F.col("rows") == 0, "info").when(F.col("broken") == 0, "pass").otherwise("fail").alias("outcome"))


def union_all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out

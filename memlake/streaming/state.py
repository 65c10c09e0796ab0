"""Keyed state for the streaming jobs.

Each function sees the rows of one key in one micro-batch; the source's rate
options (`maxFilesPerTrigger`, `maxBytesPerTrigger`) bound how many that are.
Where the result does not depend on the order, rows are folded batch by batch
and never gathered.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from memlake.config import DEFAULT, MemoryConfig
from memlake.functions.scoring import micros

Rows = Iterator[pd.DataFrame]


def _ordered(rows: Rows, by: list[str]) -> pd.DataFrame:
    return pd.concat(list(rows), ignore_index=True).sort_values(by, kind="stable")


def _micros(ts) -> int:
    return pd.Timestamp(ts).value // 1000


# -- rolling affect ----------------------------------------------------------
AFFECT = "role_id string, last_us bigint, rolling_valence double, rolling_arousal double, energy double, rows bigint"
AFFECT_STATE = "last_us bigint, w double, v double, a double, rows bigint"


def rolling_affect(entries: DataFrame, cfg: MemoryConfig = DEFAULT) -> DataFrame:
    """Decayed affect of each role at its newest entry, over its whole history.

    The decayed sums commute, so rows fold in any order. Input: `role_id`,
    `create_time`, `arousal`, `valence`. Times go to Python as numbers, since most roles have
    few rows a batch and converting a column of times costs as much as the rest.
    """
    lam, names = cfg.affect_decay_per_hour / 3.6e9, [c.split()[0] for c in AFFECT.split(", ")]

    def step(key: tuple, rows: Rows, state: GroupState) -> Iterator[pd.DataFrame]:
        last, w, v, a, n = state.get if state.exists else (-(2 ** 62), 0.0, 0.0, 0.0, 0)
        for pdf in rows:
            at = pdf["at"].to_numpy()
            new = max(last, int(at.max()))
            shrink = math.exp(-lam * (new - last)) if n else 0.0
            weight = np.exp(-lam * (new - at))
            valence, arousal = (np.nansum(weight * pdf[c].to_numpy()) for c in ("valence", "arousal"))
            w, v, a = w * shrink + weight.sum(), v * shrink + valence, a * shrink + arousal
            last, n = new, n + len(pdf)
        state.update((last, float(w), float(v), float(a), n))
        yield pd.DataFrame([(key[0], last, v / w, a / w, a, n)], columns=names)

    slim = entries.select("role_id", micros(F.col("create_time")).alias("at"), "valence", "arousal")
    return slim.groupBy("role_id").applyInPandasWithState(step, AFFECT, AFFECT_STATE, "update", GroupStateTimeout.NoTimeout)


# -- bypass rate -------------------------------------------------------------
BYPASS = "source string, query_id string, asked_us bigint"


def bypass_limit(asks: DataFrame, cfg: MemoryConfig = DEFAULT) -> DataFrame:
    """Low-confidence queries that get a bypass: N per 60 s, counted from the first after expiry.

    Input: `source`, `query_id`, `asked_at`, `best_score`.
    """

    def step(key: tuple, rows: Rows, state: GroupState) -> Iterator[pd.DataFrame]:
        start, used = state.get if state.exists else (-(2 ** 62), 0)
        out = []
        for row in _ordered(rows, ["asked_at", "query_id"]).itertuples(index=False):
            if row.best_score >= cfg.bypass_threshold:
                continue
            at = _micros(row.asked_at)
            if at - start > 60_000_000:
                start, used = at, 0
            if used < cfg.bypass_per_minute:
                used += 1
                out.append((key[0], row.query_id, at))
        state.update((start, used))
        yield pd.DataFrame(out, columns=["source", "query_id", "asked_us"])

    return asks.groupBy("source").applyInPandasWithState(step, BYPASS, "start bigint, used int", "append", GroupStateTimeout.NoTimeout)


# -- quality signals ---------------------------------------------------------
QUALITY = "source string, last_seq bigint, ema_a double, ema_b double"


def quality_ema(rates: DataFrame, cfg: MemoryConfig = DEFAULT) -> DataFrame:
    """Current exponential means of both quality signals per source (`source`, `seq`, `rate_a`, `rate_b`)."""
    alpha = max(1e-6, min(1.0, cfg.ema_alpha))

    def blend(old: float | None, new) -> float | None:
        if pd.isna(new):
            return old
        new = min(max(float(new), 0.0), 1.0)
        return new if old is None or pd.isna(old) else alpha * new + (1 - alpha) * old

    def step(key: tuple, rows: Rows, state: GroupState) -> Iterator[pd.DataFrame]:
        last, a, b = state.get if state.exists else (-1, None, None)
        for row in _ordered(rows, ["seq"]).itertuples(index=False):
            last, a, b = max(last, row.seq), blend(a, row.rate_a), blend(b, row.rate_b)
        state.update((last, a, b))
        yield pd.DataFrame([(key[0], last, a, b)], columns=["source", "last_seq", "ema_a", "ema_b"])

    return rates.groupBy("source").applyInPandasWithState(
        step, QUALITY, "last_seq bigint, ema_a double, ema_b double", "update", GroupStateTimeout.NoTimeout)

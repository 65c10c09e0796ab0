"""Recurrences y = a * y_before + b along each key, however many rows a key has.

A step is a pair (a, b), and steps compose: doing (a, b) and then (c, d) is the step
(c * a, c * b + d). So every slot of rows (`ordered.by_rows`) composes its own
steps, keys that go on into later slots pass one composed step for each slot, and
a row's value is its step applied to what came in.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from memlake.operators.ordered import ROWS_PER_SLOT, SLOT, by_rows


def compose(a: np.ndarray, b: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The steps from the beginning of each run up to every row; `first` marks the first rows of runs.

    Every round doubles how far back a row's step reaches.
    """
    a, b = a.astype(np.float64).copy(), b.astype(np.float64).copy()
    place = np.arange(len(a))
    room = place - np.maximum.accumulate(np.where(first, place, 0))  # rows of the run before this one
    d = 1
    while d <= room.max(initial=0):
        at = np.flatnonzero(room >= d)
        b[at], a[at] = a[at] * b[at - d] + b[at], a[at] * a[at - d]
        d *= 2
    return a, b


def follow(a: np.ndarray, b: np.ndarray, first: np.ndarray, start: np.ndarray) -> list[float]:
    """The recurrence row by row, from `start` at the first row of each run."""
    out, y = [], 0.0
    for x, z, new, s in zip(a.tolist(), b.tolist(), first.tolist(), start.tolist()):
        y = x * (s if new else y) + z
        out.append(y)
    return out


def _runs(rows: pd.DataFrame, keys: Sequence[str]) -> np.ndarray:
    """Whether each row begins a new key; rows are in key order."""
    first = np.zeros(len(rows), bool)
    first[:1] = True
    for k in keys:
        v = rows[k]
        same = (v == v.shift()) | (v.isna() & v.shift().isna())
        first |= ~same.to_numpy(bool)
    return first


def affine(df: DataFrame, keys: Sequence[str], order: Sequence[str], a: Column, b: Column, out: str, start: Column | None = None,
           rows_per_slot: int = ROWS_PER_SLOT) -> DataFrame:
    """Adds `out`: y = a * y_before + b over the rows of each key in `order`, which has to tell a key's rows apart.

    `start` is what comes before a key's first row (0 if not given), taken from that row. A
    slot is composed in one task of `rows_per_slot` rows; of a key in several slots one step for each slot
    meets in one task. Null steps count as doing nothing (a) and adding nothing (b).
    """
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    packed = df.select(*keys, *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], F.struct(*rest).alias("_row"),
                       F.coalesce(a.cast("double"), F.lit(1.0)).alias("_a"), F.coalesce(b.cast("double"), F.lit(0.0)).alias("_b"),
                       (F.lit(0.0) if start is None else F.coalesce(start.cast("double"), F.lit(0.0))).alias("_s"))
    by = [f"_o{i}" for i in range(len(order))]
    staged = by_rows(packed, keys, [F.col(c) for c in by], rows_per_slot)
    # the steps travel as numbers with a row's place in its slot; the rows themselves stay in Spark
    names = [*keys, *by]
    shape = T.StructType([*[staged.schema[c] for c in (*names, SLOT)], *[T.StructField(c, T.DoubleType()) for c in ("_a", "_b", "_s", "_y")]])

    def inside(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(names, kind="stable", na_position="first").reset_index(drop=True)
        first = _runs(rows, keys)
        a, b, s = (rows[c].to_numpy() for c in ("_a", "_b", "_s"))
        rows["_y"] = follow(a, b, first, s)  # what holds where the key begins in this slot
        rows["_a"], rows["_b"] = compose(a, b, first)
        rows["_s"] = s[np.flatnonzero(first)][np.cumsum(first) - 1]
        return rows
    steps = staged.select(*names, SLOT, "_a", "_b", "_s").groupBy(SLOT).applyInPandas(inside, shape)
    last = F.max_by(F.struct("_a", "_b", "_s"), F.struct(*by))
    totals = steps.groupBy(*keys, SLOT).agg(last.alias("t"))
    carried = T.StructType([*[staged.schema[c] for c in (*keys, SLOT)], T.StructField("_in", T.DoubleType())])

    def over(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(SLOT).reset_index(drop=True)
        y, came = float(rows["s"].iloc[0]), []
        for x, z in zip(rows["a"], rows["b"]):
            came.append(y)
            y = x * y + z
        return rows[[*keys, SLOT]].assign(_in=came)
    several = totals.groupBy(*keys).agg(F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    chains = totals.join(several, _null_safe(totals, several, keys), "left_semi").select(
        *keys, SLOT, F.col("t._a").alias("a"), F.col("t._b").alias("b"), F.col("t._s").alias("s"))
    coming = chains.groupBy(*keys).applyInPandas(over, carried)
    placed = steps.withColumnRenamed("_a", "_ta").withColumnRenamed("_b", "_tb")
    joined = placed.join(coming, _null_safe(placed, coming, [*keys, SLOT]), "left").select(
        *[placed[c] for c in (*names, SLOT)], F.coalesce(F.col("_ta") * F.col("_in") + F.col("_tb"), F.col("_y")).alias("_y"))
    rows = staged.select(*names, SLOT, "_row")
    return rows.join(joined, _null_safe(rows, joined, [*names, SLOT])).select(
        *[rows[k] for k in keys], *[F.col("_row")[c].alias(c) for c in rest], F.col("_y").alias(out)).select(*df.columns, out)


def _null_safe(left: DataFrame, right: DataFrame, names: Sequence[str]) -> Column:
    on = F.lit(True)
    for n in names:
        on = on & left[n].eqNullSafe(right[n])
    return on

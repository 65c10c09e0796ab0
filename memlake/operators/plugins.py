"""Extension points: scoring, tiers, retention, evidence, evaluation, embedding.

A plug-in is a plain function over columns or DataFrames, so the optimiser
sees through it; only a text model needs Python, as an Arrow UDF.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from memlake.functions import scoring
from memlake.operators import graph
from memlake.operators.monitor import union_all

Score = Callable[[DataFrame], Column]
Tier = Callable[[Column, Column], Column]
Retention = Callable[..., Column]
Evidence = Callable[[DataFrame, DataFrame, DataFrame], DataFrame]
Evaluator = Callable[[DataFrame], DataFrame]
Remediator = Callable[[DataFrame, DataFrame], DataFrame]

default_tier: Tier = scoring.tier_offset
default_retention: Retention = scoring.effective_forgetting
default_evidence: Evidence = graph.evidence_collect


def apply_score(hits: DataFrame, score: Score) -> DataFrame:
    return hits.withColumn("score", score(hits))


def apply_tier(rows: DataFrame, tier: Tier = default_tier) -> DataFrame:
    return rows.withColumn("tier", tier(F.col("rank"), F.lit(True)))


def apply_retention(timeline: DataFrame, retention: Callable[[DataFrame], Column], out: str) -> DataFrame:
    return timeline.withColumn(out, retention(timeline))


def collect_evidence(nodes: DataFrame, edges: DataFrame, members: DataFrame, policy: Evidence = default_evidence) -> DataFrame:
    return policy(nodes, edges, members)


def run_checks(df: DataFrame, checks: Mapping[str, Evaluator]) -> DataFrame:
    """Issues (`check_name`, `severity`, `subject`) of all checks; one that cannot run is a warning and not ok."""
    spark, parts = df.sparkSession, []
    for name, check in checks.items():
        try:
            parts.append(check(df).select("check_name", "severity", "subject"))
        except Exception as err:  # noqa: BLE001 - a faulty check must not stop the others
            parts.append(spark.createDataFrame([("evaluator_error", "warn", f"{name}: {err}")],
                                               "check_name string, severity string, subject string"))
    return union_all(parts)


def evaluate(df: DataFrame, checks: Mapping[str, Evaluator], remediator: Remediator | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows after at most one repair, and the issues found before it.

    The repair gets the rows and their issues, runs once, and its result is
    not checked again. It may return None to give up.
    """
    issues = run_checks(df, checks)
    fixed = remediator(df, issues) if remediator else None
    return (df if fixed is None else fixed), issues


def text_embedder(load: Callable[[], Callable[[list[str]], list[list[float]]]]) -> Callable[[Column], Column]:
    """A column function from a text model; `load` runs once per task."""
    cache: dict[str, object] = {}

    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        if "model" not in cache:
            cache["model"] = load()
        return pd.Series([list(map(float, v)) for v in cache["model"](texts.fillna("").tolist())])

    return embed

"""What a caller sees: overrides, output modes, context text, agent directives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Threat per mention, limits and the emotion changes of each action.
THREAT_STEP = 0.2
ACTIONS = (("flee", 0.6, {"fear": 0.4, "anger": 0.2}), ("watch", 0.3, {"anticipation": 0.2, "fear": 0.1}))
# Section headers of the assembled context, and the item separator.
RECALL_HEADER, SHADOW_HEADER, INPUT_HEADER = "[历史回忆]", "[残影缓冲]", "[当前输入]"
ITEM_SEPARATOR = "\n---\n"


def with_overrides(requests: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Per-request settings win over defaults for that row only."""
    return requests.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def mode_output(rows: DataFrame) -> DataFrame:
    """passive_log hides the context, only npc_agent returns directives."""
    none = F.array().cast(rows.schema["npc_directives"].dataType)
    return rows.withColumns({
        "context": F.when(F.col("mode") != "passive_log", F.col("context")),
        "npc_directives": F.when(F.col("mode") == "npc_agent", F.col("npc_directives")).otherwise(none)})


def npc_directives(items: DataFrame, npc_id: Column) -> DataFrame:
    """Threat per query from the items that mention the agent, and the action it leads to."""
    hit = F.when(F.contains(F.col("content"), npc_id), 1).otherwise(0)
    per = items.groupBy("query_id").agg(F.sum(hit).alias("mentions"))
    threat = F.round(F.col("mentions") * THREAT_STEP, 6)
    action, delta = F.lit("idle"), F.lit("")
    for name, low, change in reversed(ACTIONS):
        action = F.when(threat >= low, name).otherwise(action)
        delta = F.when(threat >= low, ",".join(f"{k}:{v}" for k, v in change.items())).otherwise(delta)
    return per.withColumns({"threat": threat, "action": action, "emotion_delta": delta})


def context_text(recall: Column, shadow: Column, turn: Column) -> Column:
    """Recall items, shadow and input under their headers; empty parts are left out."""
    part = lambda head, body: F.when(F.coalesce(F.length(body), F.lit(0)) > 0, F.concat(F.lit(head + "\n"), body))
    return F.concat_ws("\n\n", part(RECALL_HEADER, recall), part(SHADOW_HEADER, shadow), part(INPUT_HEADER, turn))

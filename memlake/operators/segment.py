"""Turning text and turns into closed and open fragments, and keeping them in bounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from memlake.config import DEFAULT, MemoryConfig
from memlake.functions import ids, scoring, text as tx
from memlake.functions.vectors import let
from memlake.operators.ordered import SLOT, running_total, with_preceding

# Marks that end a sentence when a long text is cut, in both scripts.
CUT_MARKS = ".。！？；!?\n"


def oversized(text: Column, cfg: MemoryConfig = DEFAULT) -> Column:
    return F.length(text) > cfg.force_threshold


def drop_stale(unclosed: DataFrame, as_of: Column, cfg: MemoryConfig = DEFAULT) -> DataFrame:
    """Open rows hit within the last 24 hours."""
    return unclosed.filter(F.col("last_hit_time") >= as_of - F.expr(f"interval {cfg.stale_hours} hours"))


def split_point(text: Column, cfg: MemoryConfig = DEFAULT) -> Column:
    """Length of the prefix: the sentence end nearest 0.8 within [0.7, 0.9], else null.

    Only the two stretches around the target are looked at; on equal distance
    the earlier end wins.
    """
    return let(text, lambda x: let(F.length(x), lambda n: _nearest_end(x, n, cfg)))


def _nearest_end(text: Column, n: Column, cfg: MemoryConfig) -> Column:
    share = lambda x: F.lit(round(x * 100))
    low = F.ceil(n * share(cfg.split_min) / 100).cast("int")
    mid = F.floor(n * share(cfg.split_target) / 100).cast("int")
    high = F.floor(n * share(cfg.split_max) / 100).cast("int")
    left = F.substr(text, low, mid - low + 1)
    right = F.substr(text, mid + 1, high - mid)
    # read backwards so the pattern is anchored and never retried
    back = F.length(F.regexp_extract(F.reverse(left), f"\\A[^{CUT_MARKS}]*", 0))
    before = F.when(back < mid - low + 1, mid - back)
    step = F.length(F.regexp_extract(right, f"\\A[^{CUT_MARKS}]*[{CUT_MARKS}]", 0))
    after = F.when(step > 0, mid + step)
    goal = n * share(cfg.split_target)
    nearer = lambda b, a: F.when(b.isNotNull() & (a.isNull() | (goal - b * 100 <= a * 100 - goal)), b).otherwise(a)
    return let(before, lambda b: let(after, lambda a: nearer(b, a)))


def split_overlong(fragment: DataFrame, cfg: MemoryConfig = DEFAULT) -> DataFrame:
    """Fragments over the threshold as a prefix and a tail under one split id; others whole.

    A long text without a usable sentence end stays whole and is flagged.
    """
    long = oversized(F.col("content"), cfg)
    cut = F.when(long, split_point(F.col("content"), cfg))
    staged = fragment.withColumn("_cut", cut)
    split = F.concat(F.lit("SPL-"), F.col("fragment_id"))
    piece = lambda kind, body, flag, sid: F.struct(
        F.lit(kind).alias("kind"), body.alias("content"), flag.alias("oversized"), sid.alias("split_id"))
    whole = F.array(piece("whole", F.col("content"), oversized(F.col("content"), cfg), F.lit(None).cast("string")))
    head = F.substr("content", F.lit(1), F.col("_cut"))
    rest = F.substr("content", F.col("_cut") + 1)
    both = F.array(piece("prefix", head, oversized(head, cfg), split), piece("tail", rest, oversized(rest, cfg), split))
    return staged.withColumn("p", F.explode(F.when(F.col("_cut").isNull(), whole).otherwise(both))).select("fragment_id", "p.*")


def split_ratio(prefix: Column, tail: Column, cfg: MemoryConfig = DEFAULT) -> dict[str, Column]:
    """Share of the prefix and the verdict on it; two empty texts have no share (NaN) and are rejected."""
    total = F.length(prefix) + F.length(tail)
    ratio = F.when(total == 0, F.lit(float("nan"))).otherwise(F.length(prefix) / total)
    soft = (ratio < cfg.split_min) | (ratio > cfg.split_max)
    hard = (ratio < cfg.split_min - cfg.split_tolerance) | (ratio > cfg.split_max + cfg.split_tolerance)
    return {"ratio": ratio, "verdict": F.when(hard, "reject").when(soft, "warn").otherwise("accept")}


def boundary_audit(fragment: DataFrame, cfg: MemoryConfig = DEFAULT) -> DataFrame:
    """Issue rows of fragments (`fragment_id`, `kind`, `content`, `split_id`)."""
    from memlake.operators.graph import orphan_split_pairs
    long = fragment.filter(oversized(F.col("content"), cfg)).select(
        F.col("fragment_id").alias("subject"),
        F.when(F.col("split_id").isNull(), "oversized_uc").otherwise("split_tail_still_oversized").alias("code"),
        F.lit("error").alias("severity"), F.lit("").alias("side"))
    broken = orphan_split_pairs(fragment).select(
        F.col("split_id").alias("subject"), F.lit("broken_split_pair").alias("code"), F.lit("error").alias("severity"), "side")
    size = lambda k: F.sum(F.when(F.col("kind") == k, F.length("content")))
    pairs = fragment.filter(F.col("split_id").isNotNull()).groupBy("split_id").agg(size("prefix").alias("p"), size("tail").alias("t"))
    ratio = F.col("p") / (F.col("p") + F.col("t"))
    off = pairs.filter((ratio < cfg.split_min) | (ratio > cfg.split_max)).select(
        F.col("split_id").alias("subject"), F.lit("split_ratio_off").alias("code"), F.lit("warn").alias("severity"), F.lit("").alias("side"))
    return long.unionByName(broken).unionByName(off)


def audit_verdict(issues: DataFrame) -> DataFrame:
    """Counts per severity; ok means no error."""
    return issues.agg(F.count_if(F.col("severity") == "error").alias("errors"),
                      F.count_if(F.col("severity") == "warn").alias("warns")).withColumn("ok", F.col("errors") == 0)


ANSWER = ("completed_events array<struct<content_raw_indices array<int>, continuation_of string, is_split_prefix boolean, "
          "split_id string>>, new_unclosed array<struct<indices array<int>, split_id string>>, new_unclosed_indices array<array<int>>")


def boundary_decode(answers: DataFrame) -> DataFrame:
    """Segmentation answers (`turn_id`, `text`, `answer` JSON) as completed and open fragments.

    Items without text are skipped; a split id makes a completed item a prefix,
    a prefix without one is demoted. The legacy open format is a list of
    numbers for one item or of lists for several.
    """
    shape = ANSWER.replace(" array<", ": array<").replace(" string", ": string").replace(" boolean", ": boolean")
    flat = F.from_json(F.get_json_object("answer", "$.new_unclosed_indices"), "array<int>")
    nested = F.from_json(F.get_json_object("answer", "$.new_unclosed_indices"), "array<array<int>>")
    numbers = F.get_json_object("answer", "$.new_unclosed_indices").rlike(r"^\s*\[\s*-?\d")
    base = answers.select(
        "turn_id", tx.sentences(F.col("text")).alias("s"),
        F.from_json(F.col("answer"), "struct<" + shape.split(", new_unclosed_indices")[0] + ">").alias("a"),
        F.when(numbers, F.array(flat)).otherwise(nested).alias("legacy"))
    none = F.lit(None).cast("string")
    done = F.transform("a.completed_events", lambda e: F.struct(
        F.lit("completed").alias("state"), e["content_raw_indices"].alias("ix"), e["split_id"].alias("split_id"),
        e["split_id"].isNotNull().alias("is_prefix"), e["continuation_of"].alias("continuation_of")))
    opened = lambda ix, sid: F.struct(F.lit("unclosed").alias("state"), ix.alias("ix"), sid.alias("split_id"),
                                      F.lit(False).alias("is_prefix"), none.alias("continuation_of"))
    modern = F.transform("a.new_unclosed", lambda e: opened(e["indices"], e["split_id"]))
    older = F.transform("legacy", lambda x: opened(x, none))
    rest = F.when(F.size("a.new_unclosed") > 0, modern).otherwise(older)
    empty = F.slice(F.array(opened(F.array(F.lit(0)), none)), 1, 0)
    items = F.concat(F.coalesce(done, empty), F.coalesce(rest, empty))
    return base.select("turn_id", "s", F.posexplode(items).alias("item", "e")).select(
        "turn_id", "item", "e.state", tx.pick_sentences(F.col("s"), F.col("e.ix")).alias("content"),
        "e.split_id", "e.is_prefix", "e.continuation_of").filter(F.length("content") > 0)


def gap_sessions(turns: DataFrame, gap_minutes: int, cfg: MemoryConfig = DEFAULT) -> DataFrame:
    """Close a fragment at an inactivity gap: number the sessions of each conversation.

    The gap looks one row back and the number is a running count, both inside
    time slots, so a conversation that never ends does not fill one task.
    """
    slim = turns.select("conv_id", "turn", "ts")
    back = Window.partitionBy("conv_id", SLOT).orderBy("ts", "turn")
    gap = scoring.micros(F.col("ts")) - scoring.micros(F.lag("ts").over(back))
    starts = with_preceding(slim, ["conv_id"], ["ts", "turn"], 1).withColumn(
        "is_start", F.coalesce(gap > F.lit(gap_minutes * 60_000_000), F.lit(True)).cast("int")).filter(~F.col("_carried")).drop("_carried", SLOT)
    numbered = running_total(starts, ["conv_id"], [F.col("ts"), F.col("turn")], F.col("is_start"), "session_no")
    return numbered.join(turns.select("conv_id", "turn", "text"), ["conv_id", "turn"])


def segment_turns(turns: DataFrame, gap_minutes: int, as_of: Column, cfg: MemoryConfig = DEFAULT) -> DataFrame:
    """Fragments per conversation and session: size, span, and closed or still open.

    A session is closed when later turns exist, when it is older than the gap,
    or when it ends at a sentence stop.
    """
    sessions = gap_sessions(turns, gap_minutes, cfg)
    agg = sessions.groupBy("conv_id", "session_no").agg(
        F.count("*").alias("turns"), F.sum(F.length("text")).alias("chars"), F.min("ts").alias("start_time"),
        F.max("ts").alias("end_time"), F.max_by(F.right(tx.strip(F.col("text")), F.lit(1)), F.struct("ts", "turn")).alias("last_char"))
    last = agg.groupBy("conv_id").agg(F.max("session_no").alias("_last"))
    idle = scoring.micros(as_of) - scoring.micros(F.col("end_time")) > gap_minutes * 60_000_000
    stop = F.col("last_char").isin(*[c for c in CUT_MARKS if c != "\n"])
    return agg.join(last, "conv_id").withColumn(
        "is_closed", (F.col("session_no") < F.col("_last")) | idle | stop).drop("last_char", "_last")


def open_shadow(turns: DataFrame, cfg: MemoryConfig = DEFAULT) -> DataFrame:
    """Per conversation: length of the open text and its last `safe_watermark` characters.

    Only the rows that reach into that tail are gathered.
    """
    length = (F.length("text") + 1).cast("long")
    newest = [F.col("ts").desc(), F.col("turn").desc()]
    placed = running_total(turns.select("conv_id", "turn", "ts", "text"), ["conv_id"], newest, length, "to_end")
    total = turns.groupBy("conv_id").agg((F.sum(F.length("text") + 1) - 1).alias("shadow_chars"))
    keep = placed.filter(F.col("to_end") - length <= cfg.safe_watermark)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ts", "turn", "text"))), lambda s: s["text"]), "\n")
    tail = keep.groupBy("conv_id").agg(F.right(joined, F.lit(cfg.safe_watermark)).alias("shadow"))
    return total.join(tail, "conv_id")


def redline_compact(unclosed: DataFrame, shadow_chars: Column, as_of: Column, cfg: MemoryConfig = DEFAULT) -> DataFrame:
    """What happens to each open row (`owner`, `content`, `last_hit_time`) of an owner over the redline."""
    total = unclosed.groupBy("owner").agg((F.sum(F.length("content")) + F.max(shadow_chars)).alias("total"))
    over = F.col("total") > cfg.redline
    long = F.length("content") >= cfg.len_msg * cfg.unclosed_force_ratio
    stale = F.col("last_hit_time") < as_of - F.expr(f"interval {cfg.stale_hours} hours")
    return unclosed.join(total, "owner").withColumn(
        "action", F.when(~over, "keep").when(long, "seal").when(stale, "drop").otherwise("keep"))


def redline_rows(unclosed: DataFrame, shadow: DataFrame, as_of: Column, cfg: MemoryConfig = DEFAULT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What compaction leaves behind: sealed events with the prefixes of their open row, rows still open, trimmed shadows.

    `unclosed` is (owner, item, content, last_hit_time, split_prefix_event_ids), `shadow` is
    (owner, shadow). Owners under the redline keep everything; of the others the shadow keeps its last `safe_watermark` characters.
    """
    sized = unclosed.join(shadow.select("owner", F.length("shadow").alias("_shadow")), "owner", "left").na.fill({"_shadow": 0})
    judged = redline_compact(sized, F.col("_shadow"), as_of, cfg)
    sealed = judged.filter("action = 'seal'").select(
        ids.content_id("EVT-", F.col("owner").cast("string"), F.col("item").cast("string"), F.col("content")).alias("event_id"), "owner", "item",
        F.substring("content", 1, cfg.len_msg).alias("content_raw"), F.coalesce("split_prefix_event_ids", F.array().cast("array<string>")).alias("split_prefix_event_ids"))
    kept = judged.filter("action = 'keep'").select(*unclosed.columns)
    over = judged.filter(F.col("total") > cfg.redline).select("owner").distinct().withColumn("_over", F.lit(True))
    cut = F.when(F.col("_over").isNotNull(), F.right("shadow", F.lit(cfg.safe_watermark))).otherwise(F.col("shadow"))
    return sealed, kept, shadow.join(over, "owner", "left").select("owner", cut.alias("shadow"))


def force_save(unclosed: DataFrame, current: DataFrame, cfg: MemoryConfig = DEFAULT, dedupe: bool = False) -> DataFrame:
    """Seal everything: shadow with the input per owner, and every open row on its own.

    The open text is sealed inside the shadow and alone; `dedupe` keeps only
    the former. `unclosed` is (owner, item, content), `current` is (owner, text).
    A sealed text holds `len_msg` characters, so only the open rows that reach
    into the first ones of an owner are gathered.
    """
    size = (F.length("content") + 1).cast("long")
    lead = running_total(unclosed, ["owner"], [F.col("item")], size, "upto").filter(F.col("upto") - size <= cfg.len_msg)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("item", "content"))), lambda s: s["content"]), "\n")
    shadow = lead.groupBy("owner").agg(joined.alias("shadow"))
    body = current.join(shadow, "owner", "full_outer").select("owner", F.lit("shadow").alias("source"), F.concat_ws(
        "\n", F.nullif("shadow", F.lit("")), F.nullif("text", F.lit(""))).alias("content_raw"))
    alone = unclosed.select("owner", F.concat(F.lit("open-"), "item").alias("source"), F.col("content").alias("content_raw"))
    out = body if dedupe else body.unionByName(alone)
    return out.withColumn("content_raw", F.substring("content_raw", 1, cfg.len_msg)).filter(
        tx.strip(F.col("content_raw")) != "").withColumn(
        "event_id", ids.content_id("EVT-", F.col("owner"), F.col("source"), F.col("content_raw")))


def summary_ladder(events: DataFrame, cfg: MemoryConfig = DEFAULT) -> DataFrame:
    """Extractive summaries L1..Ln of `content_raw` within the level budgets.

    Each level is the longest run of leading sentences of the one before that
    fits its budget (or the cut text when the first sentence does not). The
    ladder ends at the first level of at most 35 characters.
    """
    sizes = scoring.budget(F.length("content_raw"), cfg)
    out = events.withColumn("_b", F.struct(*[sizes[f"L{k}"].alias(f"L{k}") for k in range(1, cfg.max_levels + 1)]))
    prev = "content_raw"
    for k in range(1, cfg.max_levels + 1):
        limit = F.col(f"_b.L{k}")
        cut = F.substr(prev, F.lit(1), limit)
        lead = F.regexp_extract(cut, f"(?s)\\A.*[{CUT_MARKS}]", 0)
        whole = F.when(F.length(prev) <= limit, F.col(prev)).when(F.length(lead) > 0, lead).otherwise(cut)
        live = F.lit(True) if k == 1 else F.length(prev) > cfg.fuse_min_chars
        out = out.withColumn(f"_s{k}", F.when(live, whole))
        prev = f"_s{k}"
    entries = F.array(*[F.struct(F.lit(f"L{k}").alias("key"), F.col(f"_s{k}").alias("value")) for k in range(1, cfg.max_levels + 1)])
    kept = F.filter(entries, lambda e: F.length(e["value"]) > 0)
    return out.withColumn("summaries", F.map_from_entries(kept)).withColumn(
        "actual_max_level", F.size("summaries")).drop("_b", *[f"_s{k}" for k in range(1, cfg.max_levels + 1)])

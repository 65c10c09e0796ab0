"""Evidence graphs (abstract -> member) and split chains (tail -> prefix)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from memlake.config import DEFAULT, MemoryConfig
from memlake.functions import vectors
from memlake.operators.ordered import first_per_key, row_position, running_total
from memlake.session import checkpointed, written

LEAD_ROWS = 1000  # up to here Spark cuts to the first rows of a key before the shuffle


def source_edges(event: DataFrame) -> DataFrame:
    return event.select(F.col("event_id").alias("parent"), F.explode("source_events").alias("child"))


def leaf_resolve(nodes: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, event_id) for every basic event a root rests on.

    Tombstoned nodes cut their branch, missing ids drop out, cycles end. Only
    abstract nodes are followed round by round (few, and checkpointed); leaves
    join once at the end. A basic root is its own leaf.
    """
    starts = roots.select(F.col("event_id").alias("root")).distinct()
    below = _walked(nodes, edges, starts).join(edges, F.col("node") == F.col("parent")).select("root", F.col("child").alias("event_id"))
    own = starts.select("root", F.col("root").alias("event_id"))
    basic = nodes.filter(~F.col("is_tombstoned") & ~F.col("is_abstract")).select("event_id")
    return below.unionByName(own).join(basic, "event_id", "left_semi").select("root", "event_id").distinct()


def _walked(nodes: DataFrame, edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(root, node): every abstract node that lives and that an abstract one of `starts` (root) leads to, itself included."""
    abstract = nodes.filter(~F.col("is_tombstoned")).filter("is_abstract").select("event_id")
    climb = edges.join(abstract.select(F.col("event_id").alias("child")), "child").select("parent", "child").distinct()
    seen = frontier = checkpointed(
        starts.join(abstract.select(F.col("event_id").alias("root")), "root").select("root", F.col("root").alias("node")))
    while not frontier.isEmpty():
        step = frontier.join(climb, F.col("node") == F.col("parent")).select("root", F.col("child").alias("node")).distinct()
        frontier = checkpointed(step.join(seen, ["root", "node"], "left_anti"))
        seen = seen.unionByName(frontier)
    return seen


def evidence_collect(nodes: DataFrame, edges: DataFrame, members: DataFrame, texts: bool = True) -> DataFrame:
    """Leaves under a subset's members, each once per subset, with their reading order key.

    Subsets take the place of their members and walk down with them: one join a round gives the next nodes
    and the leaves, so each edge moves once and each leaf once a subset. Without `texts` the rows
    tell only how many characters they have (`chars`), and no text is moved.
    """
    alive = nodes.filter(~F.col("is_tombstoned")).select("event_id", "is_abstract", "create_time", F.length("content_raw").alias("chars"))
    step, seen, found = members.select("subset_id", F.col("member").alias("event_id")).distinct(), None, []
    while step is not None:
        reached = written(step.join(alive, "event_id"), "reached")
        leaves = reached.filter("not is_abstract").select("event_id", "subset_id", "create_time", "chars")
        if not found or not leaves.isEmpty():
            found = [p for p in found if not p.isEmpty()] + [leaves]
        step = reached.filter("is_abstract").select("subset_id", "event_id")
        if seen is not None and not step.isEmpty():
            step = written(step.join(seen, ["subset_id", "event_id"], "left_anti"), "step")
        seen = step if seen is None else seen.unionByName(step)
        step = None if step.isEmpty() else step.join(edges, F.col("event_id") == F.col("parent")).select(
            "subset_id", F.col("child").alias("event_id")).distinct()
    rows = found[0]
    for more in found[1:]:
        rows = rows.unionByName(more)
    rows = rows if len(found) == 1 else rows.distinct()
    return rows if not texts else rows.join(nodes.select("event_id", "content_raw"), "event_id").select(
        "event_id", "subset_id", "create_time", "content_raw")


def _chars(evidence: DataFrame) -> Column:
    return F.col("chars") if "chars" in evidence.columns else F.length("content_raw")


def leaf_evidence_stats(evidence: DataFrame, *more: Column) -> DataFrame:
    """Count, rounded mean length and target length of each subset's evidence (`chars`, or the texts themselves), and `more` aggregates."""
    mean = F.avg(_chars(evidence))
    return evidence.groupBy("subset_id").agg(
        F.count("*").alias("n"), F.bround(mean, 0).cast("int").alias("avg_len"),
        F.greatest(F.lit(1), F.floor(mean * 1.2).cast("int")).alias("target_len"), *more)


def coverage_increment(nodes: DataFrame, edges: DataFrame, members: DataFrame, coverage: DataFrame,
                       cfg: MemoryConfig = DEFAULT) -> DataFrame:
    """Coverage after each new abstract adds its share to its members and their leaves."""
    alive = nodes.filter(~F.col("is_tombstoned")).select("event_id")
    leaves = leaf_resolve(nodes, edges, members.select(F.col("member").alias("event_id")))
    touched = (
        members.select("subset_id", F.col("member").alias("event_id"))
        .unionByName(members.join(leaves, F.col("member") == F.col("root")).select("subset_id", "event_id"))
        .join(alive, "event_id", "left_semi").distinct())
    size = touched.groupBy("subset_id").agg(F.count("*").alias("n"))
    unit = cfg.coverage_strength / (1 + F.log(F.col("n")))
    gain = touched.join(size, "subset_id").groupBy("event_id").agg(F.sum(unit).alias("gain"))
    return coverage.join(gain, "event_id", "left").withColumn(
        "abstract_coverage", F.when(F.col("gain").isNotNull(), F.least(
            F.col("abstract_coverage") + F.col("gain"), F.lit(cfg.coverage_max))).otherwise(F.col("abstract_coverage"))).drop("gain")


def asf_propagate(nodes: DataFrame, leaves: DataFrame, vector: DataFrame, old: DataFrame,
                  cfg: MemoryConfig = DEFAULT) -> DataFrame:
    """Shadowing factor of each leaf after its abstracts have covered it.

    Survival multiplies over the abstracts of a leaf, so the fold is one sum of
    logarithms; immune leaves keep their factor.
    """
    info = nodes.select("event_id", F.greatest(F.length("content_raw"), F.lit(1)).alias("len"), "ptsd_immune")
    vec = vector.select("event_id", "act")
    roots = info.join(vec, "event_id").select(F.col("event_id").alias("root"), F.col("len").alias("root_len"), F.col("act").alias("root_act"))
    below = info.filter(~F.col("ptsd_immune")).join(vec, "event_id").select("event_id", "len", "act")
    hop = F.greatest(F.lit(0.0), vectors.cosine(F.col("act"), F.col("root_act")) *
                     F.least(F.lit(1.0), F.col("root_len") / F.col("len")))
    lam = min(max(cfg.shadow_lambda, 0.0), 1.0) or 0.5
    kept = F.sum(F.log(F.greatest(1 - hop * lam, F.lit(1e-12))))
    gain = leaves.join(below, "event_id").join(roots, "root").groupBy("event_id").agg(F.exp(kept).alias("survival"))
    return old.join(gain, "event_id", "left").withColumn("asf", F.when(
        F.col("survival").isNotNull(), F.least(F.lit(0.999999), 1 - (1 - F.col("asf")) * F.col("survival"))).otherwise(F.col("asf"))).drop("survival")


def narrative_dedupe(subset_leaves: DataFrame, abstract_leaves: DataFrame, abstracts: DataFrame,
                     cfg: MemoryConfig = DEFAULT, recent_k: int | None = None) -> DataFrame:
    """Subsets that retell one of the K newest abstracts (`recent_k`, smaller under load); the newest match wins.

    `subset_leaves` is (subset_id, event_id), `abstract_leaves` is (root, event_id).
    Only pairs sharing a leaf are formed, and at most K abstracts take part.
    """
    recent = abstracts.orderBy(F.col("create_time").desc(), F.col("event_id").desc()).limit(recent_k or cfg.dup_recent_k).select(
        F.col("event_id").alias("root"), "create_time")
    size = subset_leaves.groupBy("subset_id").agg(F.count("*").alias("n"))
    shared = (
        subset_leaves.join(abstract_leaves.join(recent, "root"), "event_id")
        .groupBy("subset_id", "root", "create_time").agg(F.count("*").alias("m")).join(size, "subset_id"))
    novel = F.col("n") - F.col("m")
    dup = (F.col("m") / F.col("n") >= cfg.dup_overlap) & ~(
        (novel / F.col("n") >= cfg.dup_novelty_ratio) & (novel >= cfg.dup_novelty_abs))
    best = F.max(F.struct("create_time", "root", (F.col("m") / F.col("n")).alias("overlap"), novel.alias("novelty")))
    return shared.filter(dup).groupBy("subset_id").agg(best.alias("b")).select(
        "subset_id", F.col("b.root").alias("matched_id"), "b.overlap", "b.novelty")


def mark_abstracted(event: DataFrame, members: DataFrame) -> DataFrame:
    hit = members.select(F.col("member").alias("event_id")).distinct().withColumn("_hit", F.lit(True))
    return event.join(hit, "event_id", "left").withColumn(
        "is_abstracted", F.col("is_abstracted") | (F.col("_hit").isNotNull() & ~F.col("is_abstract"))).drop("_hit")


def abstract_build(members: DataFrame, nodes: DataFrame, evidence: DataFrame) -> DataFrame:
    """Abstract event per subset: one level above its members, text cut from its evidence.

    Text comes from the earliest evidence; only as many rows of a subset as its shortest row lets
    the target length use are put in order, and a running total keeps those that it does use.
    Texts join these rows last where the evidence brings none.
    """
    level = members.join(nodes.select(F.col("event_id").alias("member"), "level"), "member").groupBy("subset_id").agg(
        (F.max("level") + 1).alias("abstraction_level"), F.count("*").alias("n_sources"))
    order = [F.col("create_time"), F.col("event_id")]
    size = (_chars(evidence) + 1).cast("long")
    sized = checkpointed(leaf_evidence_stats(evidence, F.min(size).alias("least")))
    most = sized.agg(F.max(F.floor(F.col("target_len") / F.col("least")) + 1)).first()[0] or 1
    lines = evidence.withColumn("_size", size).filter("_size is not null")
    if most <= LEAD_ROWS:
        near = first_per_key(lines, ["subset_id"], order, most).drop("rn")
        upto = Window.partitionBy("subset_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        placed = near.withColumn("upto", F.sum("_size").over(upto))
    else:
        placed = running_total(lines, ["subset_id"], order, F.col("_size"), "upto")
    lead = placed.join(sized.select("subset_id", "target_len"), "subset_id").filter(F.col("upto") - F.col("_size") <= F.col("target_len"))
    if "content_raw" not in evidence.columns:
        lead = lead.join(nodes.select("event_id", "content_raw"), "event_id")
    lead = (
        lead.groupBy("subset_id", "target_len").agg(F.array_sort(F.collect_list(F.struct("upto", "event_id", "content_raw"))).alias("t"))
        .select("subset_id", F.expr("left(array_join(transform(t, s -> s.content_raw), '\n'), target_len)").alias("content_raw")))
    return level.join(sized.drop("least"), "subset_id").join(lead, "subset_id", "left").withColumn("is_abstract", F.lit(True))


def prefix_chain(edges: DataFrame, visible: DataFrame, roots: DataFrame, cfg: MemoryConfig = DEFAULT) -> DataFrame:
    """Prefixes of each root up to depth 3, far before near.

    `edges` is (event_id, prefix_id, pos). `path` orders the chain: comparing
    paths element by element, longest first, gives ancestors before descendants.
    """
    step = edges.join(visible.select(F.col("event_id").alias("prefix_id")), "prefix_id", "left_semi").select(
        F.col("event_id").alias("node"), "prefix_id", "pos")
    cur = roots.select(F.col("event_id").alias("root"), F.col("event_id").alias("node"), F.array().cast("array<int>").alias("path"))
    found = None
    for depth in range(1, cfg.prefix_max_depth + 1):
        cur = cur.join(step, "node").select(
            "root", F.col("prefix_id").alias("node"), F.concat("path", F.array("pos")).alias("path"))
        level = cur.select("root", F.col("node").alias("prefix_id"), F.lit(depth).alias("depth"), "path")
        found = level if found is None else found.unionByName(level)
    # a shorter path must sort after the longer ones it begins: pad with a large mark
    key = F.concat("path", F.array_repeat(F.lit(2147483647), cfg.prefix_max_depth - F.size("path")))
    return found.withColumn("path", key).groupBy("root", "prefix_id").agg(
        F.min(F.struct("path", "depth")).alias("m")).select(
        "root", "prefix_id", F.col("m.depth").alias("depth"), F.col("m.path").alias("path"))


def _successors(edges: DataFrame, known: DataFrame) -> DataFrame:
    """(event_id, succ, k): known successors and newly closed events, each once, in the order of `k`."""
    fresh = edges.select(F.col("prefix_id").alias("event_id"), F.col("event_id").alias("succ"), F.lit(1).alias("age"),
                         F.lit(0).alias("block"), F.col("event_id").alias("at"))
    block = F.col("block_no") if "block_no" in known.columns else F.lit(0)
    old = known.select("event_id", block.alias("block"), F.posexplode("successors").alias("i", "succ")).select(
        "event_id", "succ", F.lit(0).alias("age"), "block", F.lpad(F.col("i").cast("string"), 9, "0").alias("at"))
    return old.unionByName(fresh).groupBy("event_id", "succ").agg(F.min(F.struct("age", "block", "at")).alias("k"))


def split_successor_link(edges: DataFrame, known: DataFrame) -> DataFrame:
    """Successor lists of prefixes with the newly closed events appended, each once, order kept.

    One list a prefix, whatever its length; `successor_blocks` gives lists of bounded size.
    """
    ordered = F.array_sort(F.collect_list(F.struct("k", "succ")))
    return _successors(edges, known).groupBy("event_id").agg(F.transform(ordered, lambda s: s["succ"]).alias("successors"))


def successor_blocks(edges: DataFrame, known: DataFrame, block: int = 1000) -> DataFrame:
    """`split_successor_link` in lists of at most `block` events: (event_id, block_no, successors).

    `known` may be such a table itself. A prefix of very many successors is
    numbered and gathered by many tasks.
    """
    placed = row_position(_successors(edges, known).filter("event_id is not null"), ["event_id"], [F.col("k"), F.col("succ")], "rn")
    ordered = F.array_sort(F.collect_list(F.struct("rn", "succ")))
    return placed.groupBy("event_id", F.floor((F.col("rn") - 1) / block).cast("int").alias("block_no")).agg(
        F.transform(ordered, lambda s: s["succ"]).alias("successors"))


def split_prefix_inherit(unclosed: DataFrame, closing: DataFrame) -> DataFrame:
    """Events sealed from an open row and its closing fragment, with the row's prefix chain."""
    return closing.join(unclosed, closing["continuation_of"] == unclosed["unclosed_id"], "left").select(
        "fragment_id", F.concat_ws("\n", F.nullif("open_text", F.lit("")), "content").alias("content_raw"),
        F.coalesce("split_prefix_event_ids", F.array().cast("array<string>")).alias("split_prefix_event_ids"))


def orphan_split_pairs(fragment: DataFrame) -> DataFrame:
    """Split ids that occur on one side only."""
    sides = fragment.filter(F.col("split_id").isNotNull()).groupBy("split_id").agg(
        F.bool_or(F.col("kind") == "prefix").alias("has_prefix"), F.bool_or(F.col("kind") == "tail").alias("has_tail"))
    return sides.filter(F.col("has_prefix") != F.col("has_tail")).select(
        "split_id", F.when(F.col("has_prefix"), "prefix").otherwise("tail").alias("side"))

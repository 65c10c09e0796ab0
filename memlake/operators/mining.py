"""Frequent sets of events that are recalled together."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from memlake.config import DEFAULT, MemoryConfig
from memlake.functions import scoring
from memlake.operators.ordered import global_position
from memlake.session import checkpointed

SETS_PER_PART = 2000


def distinct_sets(log: DataFrame, as_of: Column, lam: float) -> DataFrame:
    """Equal transactions collapsed to one row with count and decayed support.

    A set seen n times keeps n and its summed weight, which is all that
    support and pair intersection need; the sum combines before the shuffle.
    """
    weight = F.exp(F.lit(-lam) * scoring.age_days(F.col("created_at"), as_of))
    return log.groupBy(F.array_sort(F.array_distinct("event_ids")).alias("items")).agg(
        F.count("*").alias("n"), F.sum(weight).alias("w")).withColumn("sid", F.md5(F.array_join("items", "|")))


def _prefix_items(sets: DataFrame, min_size: int) -> DataFrame:
    """The items under which a set can meet another one in `min_size` items.

    With items ordered rarest first, two sets sharing `min_size` items also
    share one among the first |set|-min_size+1 of each. Items that are in very
    many sets thus rarely index anything.
    """
    item = sets.select("sid", F.explode("items").alias("item"))
    rank = item.groupBy("item").agg(F.count("*").alias("df"))
    keyed = item.join(rank, "item")
    ordered = F.array_sort(F.collect_list(F.struct("df", "item")))
    return keyed.groupBy("sid").agg(ordered.alias("o")).filter(F.size("o") >= min_size).select(
        "sid", F.explode(F.slice("o", F.lit(1), F.size("o") - min_size + 1)).alias("p")).select("sid", "p.item", "p.df")


def _part_count(df: Column) -> Column:
    return F.ceil(df / SETS_PER_PART).cast("int")


def _own_part(df: Column) -> Column:
    """The part of an item's sets that a set belongs to."""
    return F.pmod(F.xxhash64("sid"), _part_count(df).cast("long")).cast("int")


def _all_parts(df: Column) -> Column:
    return F.explode(F.sequence(F.lit(0), _part_count(df) - 1))


def with_frequent_items(sets: DataFrame, least: float, support: str) -> DataFrame:
    """The sets without items whose own support is below the least one; what becomes equal is one set.

    A frequent set has frequent items only, so no frequent set and no support changes.
    """
    item = sets.select("sid", "n", "w", F.explode("items").alias("item"))
    often = item.groupBy("item").agg(F.sum(support).alias("s")).filter(F.col("s") + 1e-6 >= least).select("item")
    left = item.join(often, "item").groupBy("sid", "n", "w").agg(F.array_sort(F.collect_list("item")).alias("items"))
    return left.groupBy("items").agg(F.sum("n").alias("n"), F.sum("w").alias("w")).withColumn("sid", F.md5(F.array_join("items", "|")))


def pair_intersections(sets: DataFrame, min_size: int) -> DataFrame:
    """Distinct T_i ∩ T_j of at least `min_size` items over all transaction pairs.

    A set that occurs twice is its own intersection. Distinct sets meet under
    their prefix items; each item group is cut into parts that are paired part
    by part, so one item shared by many sets spreads over many tasks.
    """
    twice = sets.filter((F.col("n") > 1) & (F.size("items") >= min_size)).select(F.col("items").alias("subset"))
    parts = F.ceil(F.col("df") / SETS_PER_PART).cast("int")
    idx = (_prefix_items(sets, min_size).withColumn("all", F.sequence(F.lit(0), parts - 1))
           .withColumn("part", F.pmod(F.xxhash64("sid"), parts.cast("long")).cast("int"))
           .join(sets.select("sid", "items"), "sid"))
    left = idx.select("item", F.col("part").alias("a"), F.explode("all").alias("b"), F.col("sid").alias("s1"), F.col("items").alias("i1"))
    right = idx.select("item", F.explode("all").alias("a"), F.col("part").alias("b"), F.col("sid").alias("s2"), F.col("items").alias("i2"))
    met = left.join(right, ["item", "a", "b"]).filter(F.col("s1") < F.col("s2")).select(
        F.array_sort(F.array_intersect("i1", "i2")).alias("subset")).filter(F.size("subset") >= min_size)
    return met.unionByName(twice).distinct()


def drop_one(items: Column) -> Column:
    """All subsets with one item less."""
    return F.transform(items, lambda x: F.filter(items, lambda y: y != x))


def candidates(pairs: DataFrame, min_size: int) -> DataFrame:
    smaller = pairs.filter(F.size("subset") > min_size).select(F.explode(drop_one(F.col("subset"))).alias("subset"))
    return pairs.unionByName(smaller).distinct()


def contained_in(small: DataFrame, big: DataFrame) -> DataFrame:
    """(subset, sid) for every subset that lies within a set.

    A subset is looked up under its rarest item only, and the check is one
    array test, so no list of matches per item is counted up. The sets of a
    very frequent item are cut into parts, which a subset visits one by one.
    """
    items = big.select("sid", "items", F.explode("items").alias("item"))
    rank = items.groupBy("item").agg(F.count("*").alias("df"))
    keyed = small.select("subset", F.explode("subset").alias("item")).join(rank, "item").groupBy("subset").agg(
        F.min(F.struct("df", "item")).alias("r")).select("subset", F.col("r.item").alias("item"), _all_parts(F.col("r.df")).alias("part"))
    held = items.join(rank, "item").select("sid", "items", "item", _own_part(F.col("df")).alias("part"))
    return held.join(keyed, ["item", "part"]).filter(F.size(F.array_except("subset", "items")) == 0).drop("item", "part")


def subset_support(subsets: DataFrame, sets: DataFrame) -> DataFrame:
    """Count and decayed support of each subset over all transactions."""
    return contained_in(subsets, sets).join(sets.select("sid", "n", "w"), "sid").groupBy("subset").agg(
        F.sum("n").alias("txns"), F.sum("w").alias("support"))


def closed_only(found: DataFrame) -> DataFrame:
    """Drop sets with a larger found set of equal support."""
    f = found.withColumn("sid", F.md5(F.array_join("subset", "|")))
    big = f.select("sid", F.col("subset").alias("items"))
    inside = contained_in(f.select("subset"), big).filter(F.size("items") > F.size("subset"))
    pair = inside.join(f.select("sid", F.col("support").alias("big_support")), "sid").join(
        f.select("subset", "support"), "subset")
    shadowed = pair.filter(F.abs(F.col("support") - F.col("big_support")) < 1e-9).select("subset").distinct()
    return found.join(shadowed, "subset", "left_anti")


def closed_itemsets(log: DataFrame, as_of: Column, min_size: int, min_support: float, lam: float,
                    exact: bool = False) -> DataFrame:
    """Closed frequent sets with decayed support.

    Candidates are the pair intersections and their one-smaller subsets; those
    with enough support stay, unless a larger one is equally supported. The
    collapsed transactions and the frequent sets are each used several times,
    so both are computed once and kept. `exact=True` grows the sets item by
    item instead, which gives every closed frequent set and pairs no transactions.
    """
    sets = distinct_sets(log, as_of, lam)
    if exact:
        return closed_only(checkpointed(grown_sets(sets, min_size, min_support, "w")))
    sets = checkpointed(sets)
    cand = candidates(pair_intersections(sets, min_size), min_size)
    found = checkpointed(subset_support(cand, sets).filter(F.col("support") + 1e-6 >= min_support))
    return closed_only(found)


NODE = ["head", "core"]
FEW_ROWS = 10_000
FEW_ITEMS = 14


def _later() -> Column:
    """The items of a conditional transaction that may still extend its node."""
    return F.filter("out", lambda x: x > F.col("core"))


def _extended(rows: DataFrame) -> DataFrame:
    """Conditional transactions of every one-item extension of a node: those that hold the item, without it."""
    return rows.select("head", "out", "n", "w", F.explode(_later()).alias("core")).withColumn("out", F.array_remove("out", F.col("core")))


def grown_sets(sets: DataFrame, min_size: int, least: float, support: str) -> DataFrame:
    """Every set of at least `min_size` items that is the intersection of its transactions, with `txns` and `support`.

    Only sets whose `support` column (`n` or `w`) sums to `least` are grown, so
    nothing rare is kept. Items are numbered from the rarest on. A node is a closed set (`head`) and
    the item that extends it (`core`), with the transactions that hold both as its conditional
    database: other items only, without those that are rare there, equal rows summed. Items that
    all of these rows hold belong to the closure. An extension whose closure gains an item numbered
    before `core` is dropped, since that set grows from there: every closed set comes up once, and
    rounds need not be compared with each other. Extensions too few of whose rows can
    still reach `min_size` are dropped as well. A round is some grouped sums over (node, item);
    rows of one node spread by their content, and each round is checkpointed. A closed set with at most
    FEW_ROWS distinct rows and FEW_ITEMS items to add has at most 2^FEW_ITEMS closed sets below it: one
    task finishes it by the same steps.
    """
    enough = lambda c: F.col(c) + 1e-6 >= least
    sets = with_frequent_items(sets, least, support).filter(F.size("items") >= min_size)
    held = checkpointed(sets.select("sid", "n", "w", F.explode("items").alias("name")))
    name = global_position(held.groupBy("name").agg(F.count("*").alias("df")), [F.col("df"), F.col("name")], "item").select("name", "item")
    rows = held.join(name, "name").groupBy("sid", "n", "w").agg(F.array_sort(F.collect_list("item")).alias("out")).select(
        F.array().cast("array<bigint>").alias("head"), F.lit(0).cast("bigint").alias("core"), "out", "n", "w")
    reach = F.size("head") + 1 + F.size(_later()) >= min_size
    closed = None
    while True:
        rows = checkpointed(rows.filter(F.size(_later()) > 0))
        size = rows.groupBy(*NODE).agg(F.count("*").alias("rows")).join(
            rows.select(*NODE, F.explode(_later()).alias("item")).distinct().groupBy(*NODE).agg(F.count("*").alias("items")), NODE)
        few = checkpointed(size.filter((F.col("rows") <= FEW_ROWS) & (F.col("items") <= FEW_ITEMS)).select(*NODE))
        done = checkpointed(rows.join(few, NODE, "left_semi").groupBy(*NODE).applyInPandas(
            _finisher(min_size, least, support), "whole array<bigint>, txns bigint, support double"))
        closed = done if closed is None else closed.unionByName(done)
        db = checkpointed(_extended(rows.join(few, NODE, "left_anti")))
        if db.isEmpty():
            break
        node = db.groupBy(*NODE).agg(F.sum("n").alias("txns"), F.sum("w").alias("weight"), F.sum(F.when(reach, F.col(support))).alias("hope"))
        node = checkpointed(node.filter(enough("hope")).drop("hope"))
        single = db.join(node.select(*NODE), NODE, "left_semi").withColumn("item", F.explode("out"))
        count = checkpointed(single.groupBy(*NODE, "item").agg(F.sum("n").alias("n"), F.sum("w").alias("w")))
        common = node.join(count.select(*NODE, "item", F.col("n").alias("_n")), NODE, "left").groupBy(*NODE, "txns", "weight").agg(
            F.array_sort(F.collect_list(F.when(F.col("_n") == F.col("txns"), F.col("item")))).alias("also"))
        grown = checkpointed(common.filter((F.size("also") == 0) | (F.array_min("also") > F.col("core"))).withColumn(
            "whole", F.array_sort(F.concat("head", F.array("core"), "also"))).drop("also"))
        closed = closed.unionByName(grown.filter(F.size("whole") >= min_size).select("whole", "txns", F.col("weight").alias("support")))
        left = count.filter(enough(support)).join(grown.select(*NODE, "whole", "txns"), NODE).filter(F.col("n") < F.col("txns")).select(*NODE, "item", "whole")
        rows = single.join(left, [*NODE, "item"]).groupBy("whole", "core", "out").agg(
            F.max("n").alias("n"), F.max("w").alias("w"), F.array_sort(F.collect_list("item")).alias("kept")).groupBy(
            F.col("whole").alias("head"), "core", F.col("kept").alias("out")).agg(F.sum("n").alias("n"), F.sum("w").alias("w"))
    named = closed.select("whole", "txns", "support", F.explode("whole").alias("item")).join(name, "item")
    return named.groupBy("whole", "txns", "support").agg(F.array_sort(F.collect_list("name")).alias("subset")).select("subset", "txns", "support")


def _finisher(min_size: int, least: float, support: str):
    """All closed sets below one small closed set, depth first, by the steps of a round."""
    def run(node: pd.DataFrame) -> pd.DataFrame:
        rows = [(frozenset(o), n, w) for o, n, w in zip(node.out, node.n, node.w)]
        todo, found = [(frozenset(node["head"].iloc[0]), int(node.core.iloc[0]), rows)], []
        while todo:
            head, last, rows = todo.pop()
            for core in {i for out, _, _ in rows for i in out if i > last}:
                own = [(out - {core}, n, w) for out, n, w in rows if core in out]
                txns, weight = sum(n for _, n, _ in own), sum(w for _, _, w in own)
                held = {i: [0, 0.0] for out, _, _ in own for i in out}
                for out, n, w in own:
                    for i in out:
                        held[i][0] += n
                        held[i][1] += w
                also = {i for i, (n, _) in held.items() if n == txns}
                if (txns if support == "n" else weight) + 1e-6 < least or min(also, default=core) < core:
                    continue
                whole = head | {core} | also
                if len(whole) >= min_size:
                    found.append((sorted(whole), txns, weight))
                kept = {i for i, sums in held.items() if sums[support == "w"] + 1e-6 >= least} - also
                less: dict[frozenset, list] = {}
                for out, n, w in own:
                    sums = less.setdefault(out & kept, [0, 0.0])
                    sums[0] += n
                    sums[1] += w
                todo.append((whole, core, [(out, n, w) for out, (n, w) in less.items()]))
        return pd.DataFrame(found, columns=["whole", "txns", "support"])
    return run


def frequent_subsets(log: DataFrame, min_size: int, min_support: int) -> DataFrame:
    """All intersections of transactions with their plain, undecayed support."""
    zero = F.lit("1970-01-01").cast("timestamp")
    return grown_sets(distinct_sets(log, zero, 0.0), min_size, min_support, "n").select("subset", F.col("txns").alias("support"))


def fired_anti(subsets: DataFrame, fired: DataFrame) -> DataFrame:
    """Subsets whose fingerprint has not fired yet."""
    return subsets.withColumn("fingerprint", F.array_join(F.array_sort("subset"), "|")).join(
        fired.select("fingerprint"), "fingerprint", "left_anti")


def replace_subset(log: DataFrame, subset: Column, abstract_id: Column) -> DataFrame:
    """Rows that contain the subset get the abstract id in its place."""
    hit = F.size(F.array_except(subset, F.col("event_ids"))) == 0
    new = F.array_sort(F.array_union(F.array_except("event_ids", subset), F.array(abstract_id)))
    return log.withColumns({"changed": hit, "event_ids": F.when(hit, new).otherwise(F.col("event_ids"))})


def replace_subsets(log: DataFrame, made: list[tuple[str, list[str]]]) -> DataFrame:
    """Apply replacements one after the other in a single pass over the log."""
    if not made:
        return log
    steps = F.array(*[F.struct(F.lit(i).alias("id"), F.array(*[F.lit(m) for m in members]).alias("s")) for i, members in made])

    def step(ids: Column, r: Column) -> Column:
        new = F.array_sort(F.array_union(F.array_except(ids, r["s"]), F.array(r["id"])))
        return F.when(F.size(F.array_except(r["s"], ids)) == 0, new).otherwise(ids)
    return log.withColumn("event_ids", F.aggregate(steps, F.col("event_ids"), step))


def coherence_gate(parts: DataFrame, cfg: MemoryConfig = DEFAULT) -> DataFrame:
    """Check each (`subset`, `coherent`, `excluded`) partition and rate it."""
    s, c, x = [F.array_distinct(n) for n in ("subset", "coherent", "excluded")]
    valid = ((F.size(F.array_except(F.array_union(c, x), s)) == 0) & (F.size(F.array_intersect(c, x)) == 0)
             & (F.size(F.array_except(s, F.array_union(c, x))) == 0))
    rate = F.when(valid, F.size(c) / F.greatest(F.size(s), F.lit(1))).otherwise(F.lit(0.0))
    return parts.withColumns({
        "is_valid": valid, "rate": rate,
        "passed": valid & (F.size(c) >= max(1, cfg.coherence_min)),
        "kept": F.when(valid, c).otherwise(F.array().cast("array<string>"))})


def relevance_rate(parts: DataFrame) -> DataFrame:
    """Related share of recalled items: 1 for none, 0.5 for an invalid partition."""
    s, c, x = [F.array_distinct(n) for n in ("subset", "coherent", "excluded")]
    valid = ((F.size(F.array_except(F.array_union(c, x), s)) == 0) & (F.size(F.array_intersect(c, x)) == 0)
             & (F.size(F.array_except(s, F.array_union(c, x))) == 0))
    return parts.withColumn("rate", F.when(F.size(s) == 0, 1.0).when(valid, F.size(c) / F.size(s)).otherwise(F.lit(0.5)))

"""Literal cases with known answers, as tiny DataFrames."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows
from memlake.config import DEFAULT, MemoryConfig
from memlake.functions import affect, scoring, text as tx, vectors
from memlake.operators import graph, mining, monitor, recall, roles, sampling, search, segment, timeline as tl
from memlake.operators.ordered import by_rows, exact_percentile, running_total, value_at_rank, with_preceding
from memlake.plans.mine import mine_abstracts
from memlake.sources import corpus, lake

T0 = dt.datetime(2024, 1, 1)
DAY = dt.timedelta(days=1)


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).collect()[0]


def log_of(spark, sets):
    return spark.createDataFrame([(f"R{i:03d}", T0, list(s)) for i, s in enumerate(sets)],
                                 "recall_id string, created_at timestamp_ntz, event_ids array<string>")


# -- scoring -------------------------------------------------------------------
def test_base_forgetting_is_25_at_half(spark):
    assert one(spark, x=affect.base_forgetting(F.lit(0.5))).x == pytest.approx(25.0)


def test_reinforce_lifts_a_factor_of_one_and_stops_at_the_cap(spark):
    r = one(spark, a=scoring.reinforced(F.lit(1.0)), b=scoring.reinforced(F.lit(290.0)))
    assert r.a >= 1.5 and r.b == 300.0


def test_factor_has_the_last_bit_of_the_c_library(spark):
    got = spark.range(100).select("id", scoring.factor_modifier(F.col("id").cast("double")).alias("f")).collect()
    assert [r.id for r in got if r.f != 1 + 0.5 * math.log10(1 + r.id)] == []


def test_coverage_weight(spark):
    r = one(spark, a=scoring.coverage_weight(F.lit(0.0)), b=scoring.coverage_weight(F.lit(1.0)))
    assert r.a == 1.0 and r.b == pytest.approx(math.exp(-2))


def test_penalised_old_entry_scores_below_one(spark):
    e = spark.createDataFrame([("r", "e", T0, T0, 0.1, 1.0)],
                              "role_id string, event_id string, create_time timestamp_ntz, last_accessed_time timestamp_ntz, memory_weight double, forgetting_factor double")
    r = tl.forgetting_scores(e, F.lit(T0 + 120 * DAY)).collect()[0]
    assert r.score_plain == 1.0 and r.score_penalised < 1.0


@pytest.mark.parametrize("rank,focus,want", [(5, True, -1), (4, True, -1), (3, True, 0), (2, True, 1), (1, True, 1), (5, False, 0), (0, True, 1)])
def test_tier_offset(spark, rank, focus, want):
    assert one(spark, x=scoring.tier_offset(F.lit(rank), F.lit(focus))).x == want


@pytest.mark.parametrize("offset,level", [(-1, "L1"), (1, "L3")])
def test_summary_pick_follows_the_tier(spark, offset, level):
    lv = F.map_from_arrays(F.array(*[F.lit(f"L{k}") for k in (1, 2, 3)]), F.array(*[F.repeat(F.lit("x"), F.lit(n)) for n in (400, 120, 40)]))
    p = one(spark, p=recall.summary_pick(recall.level_array(lv), F.lit("raw"), F.lit(9999), F.lit(offset))).p
    assert p.level == level


def test_load_limits_at_tenfold_overload(spark):
    r = one(spark, a=scoring.adjusted_limit(F.lit(100000), F.lit(20000), scoring.load_of(F.lit(10.0))),
            b=scoring.adjusted_limit(F.lit(200), F.lit(20), scoring.load_of(F.lit(10.0))))
    assert (r.a, r.b) == (20000, 20)


def test_hybrid_score_parts(spark):
    parts = scoring.hybrid_parts(F.lit(0.7), F.lit(T0), F.lit(T0), scoring.importance_boost(F.lit("A")), F.lit(0.0), F.lit(0.2))
    r = one(spark, **parts)
    assert r.role_boost == 0.2 and 0 <= r.total <= 1


def test_nearer_hit_ranks_first(spark):
    h = spark.createDataFrame([("q", "far", 0.8, 1.0, 0.0, 0.0), ("q", "near", 0.2, 1.0, 0.0, 0.0)],
                              "query_id string, event_id string, distance double, weight double, event_valence double, query_valence double")
    assert recall.rrf_single(h).orderBy("place").first().event_id == "near"


# -- sampling --------------------------------------------------------------------
def test_heavier_event_wins_the_pool_and_shadowing_lowers_it(spark):
    keys = spark.createDataFrame([("A", 5.0, 0.0, 0.9), ("B", 50.0, 0.0, 0.9), ("C", 1.0, 0.0, 0.01)], "event_id string, w double, asf double, u double")
    keyed = keys.withColumn("sample_key", scoring.sample_key(F.col("u"), scoring.w_eff(F.col("w"), F.col("asf"))))
    assert sampling.active_pool(keyed, 2).collect()[0].event_id == "B"
    xy = spark.createDataFrame([("X", 10.0, 0.5, 0.5), ("Y", 10.0, 0.0, 0.5)], "event_id string, w double, asf double, u double")
    keyed = xy.withColumn("sample_key", scoring.sample_key(F.col("u"), scoring.w_eff(F.col("w"), F.col("asf"))))
    assert [r.event_id for r in sampling.active_pool(keyed, 2).collect()] == ["Y", "X"]


# -- graph -------------------------------------------------------------------------
NODE = "event_id string, is_abstract boolean, is_tombstoned boolean, create_time timestamp_ntz, content_raw string, ptsd_immune boolean, level int"


def nodes(spark, *specs):
    return spark.createDataFrame([(i, a, d, T0, c, im, 0) for i, a, d, c, im in specs], NODE)


def test_leaves_skip_tombstones_missing_ids_and_cycles(spark):
    n = nodes(spark, ("top", True, False, "", False), ("mid", True, False, "", False), ("dead", True, True, "", False),
              ("a", False, False, "", False), ("b", False, False, "", False), ("c", False, True, "", False), ("d", False, False, "", False))
    e = spark.createDataFrame([("top", "mid"), ("mid", "a"), ("mid", "c"), ("mid", "top"), ("top", "dead"), ("dead", "d"), ("top", "b"), ("top", "gone")],
                              "parent string, child string")
    out = graph.leaf_resolve(n, e, n.filter("event_id in ('top', 'mid', 'a', 'dead')"))
    assert rows(out, "root", "event_id") == [("a", "a"), ("mid", "a"), ("mid", "b"), ("top", "a"), ("top", "b")]


def test_coverage_adds_up_to_the_cap(spark):
    n = nodes(spark, ("e", False, False, "", False))
    edges = spark.createDataFrame([], "parent string, child string")
    m = spark.createDataFrame([("S", "e")], "subset_id string, member string")
    cov = spark.createDataFrame([("e", 0.0)], "event_id string, abstract_coverage double")
    first = graph.coverage_increment(n, edges, m, cov, MemoryConfig(coverage_strength=1.5))
    assert first.first().abstract_coverage == 1.5
    again = graph.coverage_increment(n, edges, m, first, MemoryConfig(coverage_strength=5.0))
    assert again.first().abstract_coverage == 3.0


def test_shadowing_multiplies_survival_and_spares_the_immune(spark):
    n = nodes(spark, ("A", True, False, "xx", False), ("l", False, False, "xxxx", False), ("i", False, False, "x", True))
    leaves = spark.createDataFrame([("A", "l"), ("A", "i")], "root string, event_id string")
    vec = spark.createDataFrame([("A", [1.0, 0.0]), ("l", [0.8, 0.6]), ("i", [0.9, 0.1])], "event_id string, act array<double>")
    old = spark.createDataFrame([("l", 0.0), ("i", 0.0)], "event_id string, asf double")
    out = dict(rows(graph.asf_propagate(n, leaves, vec, old), "event_id", "asf"))
    assert out["l"] == pytest.approx(1 - (1 - 0.8 * 0.5 * 0.5)) and out["i"] == 0.0


@pytest.mark.parametrize("subset,abstract,dup", [
    (["e0", "e1", "new"], ["e0", "e1", "e2"], True),
    (["a", "b", "c", "n1", "n2"], ["a", "b", "c", "d", "e"], False),
    (["e0", "n1", "n2", "n3"], ["e0", "e1"], False)])
def test_narrative_duplicates(spark, subset, abstract, dup):
    sl = spark.createDataFrame([("S", x) for x in subset], "subset_id string, event_id string")
    al = spark.createDataFrame([("A", x) for x in abstract], "root string, event_id string")
    ab = spark.createDataFrame([("A", T0)], "event_id string, create_time timestamp_ntz")
    found = graph.narrative_dedupe(sl, al, ab, MemoryConfig(dup_overlap=0.6)).collect()
    assert bool(found) == dup
    if dup:
        assert found[0].overlap == pytest.approx(2 / 3) and found[0].novelty == 1


def test_newest_duplicate_wins_and_k_hides_old_ones(spark):
    sl = spark.createDataFrame([("S", "a"), ("S", "b")], "subset_id string, event_id string")
    al = spark.createDataFrame([("old", "a"), ("old", "b"), ("new", "a"), ("new", "b")], "root string, event_id string")
    ab = spark.createDataFrame([("old", T0), ("new", T0 + DAY)], "event_id string, create_time timestamp_ntz")
    assert graph.narrative_dedupe(sl, al, ab).first().matched_id == "new"
    assert not graph.narrative_dedupe(sl, al.filter("root = 'old'"), ab, MemoryConfig(dup_recent_k=1)).collect()


def test_prefix_comes_before_its_tail_once(spark):
    e = spark.createDataFrame([("t", "p", 0), ("p", "g", 0)], "event_id string, prefix_id string, pos int")
    vis = spark.createDataFrame([("p",), ("g",), ("t",)], "event_id string")
    block = spark.createDataFrame([("q", "t", 1, 1.0, "tail text"), ("q", "p", 2, 0.5, "prefix text")],
                                  "query_id string, event_id string, position int, score double, text string")
    chain = graph.prefix_chain(e, vis, vis).withColumn("text", F.lit("short"))
    out = recall.prefix_expand(block, chain, 20000).orderBy("out_position").collect()
    assert [r.event_id for r in out] == ["g", "p", "t"]
    assert out[1].is_anchor and out[1].text == "prefix text" and out[0].score == pytest.approx(0.9)


def test_prefix_texts_join_the_finished_rows(spark):
    block = spark.createDataFrame([("q", "t", 1, 1.0, "t" * 90), ("q", "p", 2, 0.5, "p" * 80), ("r", "t", 1, 1.0, "T" * 70)],
                                  "query_id string, event_id string, position int, score double, text string")
    chain = spark.createDataFrame([("t", "g", [0, 0], "g" * 60), ("t", "p", [0, 9], "s" * 50), ("p", "g", [0, 9], "x" * 60)],
                                  "root string, prefix_id string, path array<int>, text string")
    out = rows(recall.prefix_expand(block, chain, 100), "query_id", "event_id", "out_position", "is_anchor", "text")
    stub = lambda name, letter: f"[{name}] " + letter * 40 + "…"
    assert out == [("q", "g", 1, False, stub("g", "g")), ("q", "p", 2, True, "p" * 80), ("q", "t", 3, True, "t" * 90),
                   ("r", "g", 1, False, stub("g", "g")), ("r", "p", 2, False, stub("p", "s")), ("r", "t", 3, True, "T" * 70)]
    one_text = spark.createDataFrame([("t", "t" * 90), ("p", "p" * 80), ("g", "g" * 60)], "event_id string, text string")
    sizes = lambda df: df.withColumn("chars", F.length("text")).drop("text")
    lean = recall.prefix_expand(sizes(block.filter("query_id = 'q'")), sizes(chain), 100, texts=one_text)
    assert rows(lean, "query_id", "event_id", "out_position", "is_anchor", "text") == out[:3]
    # no aggregation or window holds a text
    plan = lean._jdf.queryExecution().optimizedPlan().toString().splitlines()
    steps = [line for line in plan if "Aggregate" in line or "Window" in line]
    assert steps and not [line for line in steps if " text#" in line or "(text#" in line]


def test_focus_roles_meet_the_hits_of_their_queries_only(spark):
    hits = spark.createDataFrame([(f"q{i}", f"e{i}-{j}", j / 10, T0) for i in range(40) for j in range(3)],
                                 "query_id string, event_id string, distance double, create_time timestamp_ntz")
    roles_ = hits.select("event_id", F.when(F.col("event_id").endswith("-2"), "other").otherwise("K").alias("role_id"))
    focus = hits.select("query_id", F.lit("K").alias("role_id")).distinct()
    out = search.capacity_tiers(hits, F.lit(T0 + DAY).cast("timestamp_ntz"), roles_, focus)
    assert out.count() == 80 and not out.filter(F.col("event_id").endswith("-2")).count()
    # all queries share one role: no join may be on the role alone
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line]
    assert joins and not [line for line in joins if "role_id" in line and "query_id" not in line]


def test_search_in_passes_holds_few_rows_and_loses_none(spark, monkeypatch):
    rng = np.random.default_rng(3)
    vec = lambda prefix, n: spark.createDataFrame([(f"{prefix}{i}", rng.normal(size=4).tolist(), rng.normal(size=3).tolist()) for i in range(n)], ["id", "act", "emo"])
    asked, events = vec("q", 50).withColumnRenamed("id", "query_id"), vec("e", 40).withColumnRenamed("id", "event_id").repartition(20)
    whole = rows(search.bands_topk(asked, events, 5, ["act", "emo"]))
    seen = []
    real = search._pass
    monkeypatch.setattr(search, "_pass", lambda held, shared, k: seen.append((held.rdd.getNumPartitions(), max(len(n) for n, _ in shared.value.values()))) or real(held, shared, k))
    monkeypatch.setattr(search, "PASS_ROWS", 100)
    monkeypatch.setattr(search, "BLOCK_QUERIES", 4)
    assert rows(search.bands_topk(asked, events, 5, ["act", "emo"])) == whole and len(whole) == 500
    assert len(seen) == 5 and all(parts <= spark.sparkContext.defaultParallelism and most < 25 for parts, most in seen)


@pytest.mark.parametrize("name", ["event_out", "compression_audit"])
def test_texts_join_events_last(spark, sf, name):
    from memlake import registry
    plan = registry.queries()[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line]
    assert len(joins) > 1 and "doc_id" in joins[0]


# -- mining ------------------------------------------------------------------------
E6 = [f"e{i}" for i in range(1, 7)]


def test_all_frequent_subsets_are_kept(spark):
    out = mining.frequent_subsets(log_of(spark, [E6] * 4 + [E6[:4]] * 2), 3, 4)
    assert {tuple(r.subset): r.support for r in out.collect()} == {tuple(E6): 4, tuple(E6[:4]): 6}


def brute_closed(sets, min_size, min_support):
    from itertools import combinations
    cand = {frozenset(a) & frozenset(b) for a, b in combinations(sets, 2)}
    cand = {c for c in cand if len(c) >= min_size}
    cand |= {c - {x} for c in cand for x in c if len(c) > min_size}
    sup = {c: sum(c <= set(s) for s in sets) for c in cand}
    sup = {c: n for c, n in sup.items() if n >= min_support}
    return {tuple(sorted(c)): n for c, n in sup.items() if not any(c < d and n == m for d, m in sup.items())}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_closed_sets_equal_brute_force(spark, seed, monkeypatch):
    import random
    rng = random.Random(seed)
    items = [f"i{k}" for k in range(9)]
    sets = [sorted(set(rng.choices(items, weights=range(9, 0, -1), k=rng.randint(2, 9)))) for _ in range(40)]
    monkeypatch.setattr(mining, "SETS_PER_PART", 5)
    out = mining.closed_itemsets(log_of(spark, sets), F.lit(T0), 2, 3, 0.0)
    got = {tuple(r.subset): round(r.support) for r in out.collect()}
    assert got == brute_closed(sets, 2, 3)


def test_exact_mode_gives_every_closed_set(spark):
    from itertools import combinations
    sets = [E6[:4], E6[1:5], E6[2:], [*E6[:3], "e6"], E6, E6[:5], ["e1", "e3", "e5"]]
    sup = {c: sum(set(c) <= set(s) for s in sets) for n in range(2, 7) for c in combinations(E6, n)}
    want = {c: n for c, n in sup.items() if n >= 2 and not any(set(c) < set(d) and m == n for d, m in sup.items())}
    out = mining.closed_itemsets(log_of(spark, sets), F.lit(T0), 2, 2, 0.0, exact=True)
    assert {tuple(r.subset): round(r.support) for r in out.collect()} == want


def plain_closed(sets, min_size, least):
    """Closed sets by closing every one-item extension, depth first."""
    sets = [frozenset(s) for s in sets]
    todo, seen = [frozenset([i]) for i in set().union(*sets)], {}
    while todo:
        inside = [s for s in sets if todo[-1] <= s]
        todo.pop()
        if len(inside) >= least:
            whole = frozenset.intersection(*inside)
            if whole not in seen:
                seen[whole] = len(inside)
                todo += [whole | {i} for i in set().union(*inside) - whole]
    return {tuple(sorted(c)): n for c, n in seen.items() if len(c) >= min_size}


@pytest.mark.parametrize("seed, few", [(1, 14), (2, 14), (3, 14), (3, 2)])
def test_grown_sets_equal_plain_closed_sets(spark, seed, few, monkeypatch):
    import random
    monkeypatch.setattr(mining, "FEW_ITEMS", few)
    rng = random.Random(seed)
    items = [f"i{k}" for k in range(9)]
    sets = [sorted(set(rng.choices(items, weights=range(9, 0, -1), k=rng.randint(1, 9)))) for _ in range(40)]
    if seed == 3:
        sets = [sorted({*s, "i0", "i5"}) for s in sets]
    for min_size, least in ((1, 2), (2, 3), (3, 6)):
        got = {tuple(r.subset): r.support for r in mining.frequent_subsets(log_of(spark, sets), min_size, least).collect()}
        assert got == plain_closed(sets, min_size, least)


def test_a_long_planted_set_is_grown_without_meeting_pairs(spark):
    import random
    rng = random.Random(5)
    planted = [f"p{k:02d}" for k in range(25)]
    sets = [sorted([*planted, f"u{i}"]) for i in range(20)] + [sorted(rng.sample(planted, 12)) for _ in range(40)]
    sets += [sorted(rng.sample([f"n{k}" for k in range(30)], 8)) for _ in range(60)]
    want = plain_closed(sets, 6, 24)
    got = {tuple(r.subset): r.support for r in mining.frequent_subsets(log_of(spark, sets), 6, 24).collect()}
    assert got == want and want
    assert {tuple(r.subset): r.support for r in mining.frequent_subsets(log_of(spark, sets), 6, 20).collect()}[tuple(planted)] == 20


def test_no_transactions_and_no_frequent_set(spark):
    assert mining.frequent_subsets(log_of(spark, []), 2, 1).isEmpty()
    assert mining.frequent_subsets(log_of(spark, [E6]), 2, 2).isEmpty()
    assert mining.frequent_subsets(log_of(spark, [E6] * 2), 7, 2).isEmpty()


def test_frequent_counts_agree_with_fpgrowth(spark):
    from pyspark.ml.fpm import FPGrowth
    log = log_of(spark, [E6] * 4 + [E6[:4]] * 2 + [E6[2:]] * 3)
    ours = {tuple(r.subset): r.support for r in mining.frequent_subsets(log, 2, 3).collect()}
    model = FPGrowth(itemsCol="event_ids", minSupport=3 / 9, minConfidence=0.9).fit(log)
    theirs = {tuple(sorted(r["items"])): r.freq for r in model.freqItemsets.collect()}
    assert ours and all(theirs[k] == v for k, v in ours.items())


def none_fired(spark):
    return spark.createDataFrame([], "fingerprint string, abstract_event_id string")


SMALL = MemoryConfig(min_size=3, min_support=3, escalated_support=4)


def test_one_row_gives_nothing(spark):
    assert not mine_abstracts(log_of(spark, [E6[:3]]), none_fired(spark), F.lit(T0), SMALL).abstract.collect()


def test_a_subset_in_three_rows_gives_one_abstract_once(spark):
    log = log_of(spark, [E6[:3], E6[:3], [*E6[:3], "x"]])
    out = mine_abstracts(log, none_fired(spark), F.lit(T0), SMALL)
    made = out.abstract.collect()
    assert [r.members for r in made] == [E6[:3]]
    assert {tuple(r.event_ids) for r in out.log.collect()} == {(made[0].abstract_id,), (made[0].abstract_id, "x")}
    assert not mine_abstracts(log, out.fired, F.lit(T0), SMALL).abstract.collect()


@pytest.mark.parametrize("coherent,members", [(E6[:4], E6[:4]), (E6[:3], E6[:3]), (E6[:2], None)])
def test_coherence_gate_decides_on_the_abstract(spark, coherent, members):
    keep = F.array(*[F.lit(x) for x in coherent])
    part = lambda df: df.withColumns({"coherent": F.array_intersect("subset", keep), "excluded": F.array_except("subset", keep)})
    out = mine_abstracts(log_of(spark, [E6[:4]] * 3), none_fired(spark), F.lit(T0), SMALL, partition=part, max_rounds=1)
    assert [r.members for r in out.abstract.collect()] == ([members] if members else [])


def test_a_subset_of_dead_events_is_marked_and_not_retried(spark):
    alive = spark.createDataFrame([(x,) for x in E6[1:]], "event_id string")
    out = mine_abstracts(log_of(spark, [E6[:3]] * 3), none_fired(spark), F.lit(T0), SMALL, alive=alive, max_rounds=1)
    assert not out.abstract.collect()
    assert [r.abstract_event_id for r in out.fired.collect()] == ["__skipped_abstraction_mining_noop__"]


def test_new_abstracts_live_on_as_members(spark):
    """Three sets that nest: each abstract is a living member of the next one."""
    a, b = E6[:3], ["p", "q"]
    log = log_of(spark, [a] * 5 + [[*a, *b]] * 5)
    alive = spark.createDataFrame([(x,) for x in [*a, *b]], "event_id string")
    plain = mine_abstracts(log, none_fired(spark), F.lit(T0), SMALL).abstract.collect()
    held = mine_abstracts(log, none_fired(spark), F.lit(T0), SMALL, alive=alive)
    assert [r.members for r in held.abstract.collect()] == [r.members for r in plain] and len(plain) == 2
    assert all(not r.abstract_event_id.startswith("__") for r in held.fired.collect())


def test_new_abstracts_shadow_later_sets(spark):
    cfg = MemoryConfig(min_size=3, min_support=3, escalated_support=4)
    log = log_of(spark, [E6[:5]] * 4 + [E6[:4]] * 4)
    known = spark.createDataFrame([], "event_id string, create_time timestamp_ntz")
    out = mine_abstracts(log, none_fired(spark), F.lit(T0), cfg, known=known)
    made = {r.abstract_id for r in out.abstract.collect()}
    assert made and any(r.abstract_event_id in made and r.fingerprint not in {"|".join(x.members) for x in out.abstract.collect()} for r in out.fired.collect())


def test_sets_without_evidence_are_marked(spark):
    basic = spark.createDataFrame([("other",)], "event_id string")
    out = mine_abstracts(log_of(spark, [E6[:3]] * 3), none_fired(spark), F.lit(T0), SMALL, evidence=basic, max_rounds=1)
    assert not out.abstract.collect() and [r.abstract_event_id for r in out.fired.collect()] == ["__skipped_abstraction_mining_noop__"]


def test_thresholds_have_a_floor_and_never_fall():
    from memlake.plans.mine import thresholds
    low = MemoryConfig(min_size=1, min_support=1, escalated_support=1, escalate_after=2)
    assert thresholds(0, low) == thresholds(9, low) == (2, 2)
    assert thresholds(3, MemoryConfig(min_support=9, escalated_support=4, escalate_after=2)) == (6, 9)


def test_whole_files_are_read_between_markers(spark, tmp_path):
    for name, body in (("a", "x<s>one\r\ntwo<e>y"), ("b", "no markers"), ("c", "")):
        (tmp_path / f"{name}.txt").write_bytes(body.encode())
    got = {r.path.rsplit("/", 1)[1]: r.text for r in corpus.read_corpus(spark, str(tmp_path), "<s>", "<e>").collect()}
    assert got["a.txt"] == "one\ntwo" and got["b.txt"] == "no markers"


def test_questions_become_blocks(spark, sf):
    """Recall with encoded questions: every block under the redline, the log in block order, reinforced entries stronger."""
    from memlake.mappings import Tables
    from memlake.plans import recall_job as rj
    from memlake.registry.search import encode_events
    t = Tables(spark, sf)
    asks = t.turn.filter("turn = 0").select(F.col("turn_id").alias("query_id"), "text", F.lit("KEY_3 was here").alias("shadow"), F.col("ts").cast("timestamp").alias("asked_at"))
    focus, asked = rj.prepare(asks, t.role, t.event_role)
    encoded = rj.encode_routes(asked, 32)
    assert {r.route for r in encoded.select("route").distinct().collect()} >= {0, 1}
    events = t.event_text.filter("n < 200")
    memory = rj.Memory(events, t.event_role, t.timeline, encode_events(events, t.event_role, t.role, 32))
    cfg = MemoryConfig(context_window=3300)
    out = rj.recall_job(asked, encoded, focus, memory, t.as_of, cfg)
    size = out.block.groupBy("query_id").agg(F.sum(F.length("text")).alias("n"))
    assert size.count() > 0 and size.filter(F.col("n") > cfg.redline).isEmpty()
    assert out.log.count() == size.count() and out.granted.count() > 0
    better = out.timeline.withColumnRenamed("forgetting_factor", "after").join(t.timeline, ["role_id", "event_id"]).filter("after > forgetting_factor")
    assert not better.join(out.block, "event_id", "left_semi").isEmpty() and better.join(out.block, "event_id", "left_anti").isEmpty()


# -- text and segmentation ------------------------------------------------------------
def frag(spark, *specs):
    return spark.createDataFrame([(f"f{i}", k, "x" * n, s) for i, (k, n, s) in enumerate(specs)],
                                 "fragment_id string, kind string, content string, split_id string")


@pytest.mark.parametrize("specs,codes", [
    ([("tail", 500, None)], {"oversized_uc"}),
    ([("prefix", 60, "s"), ("tail", 15, "s")], set()),
    ([("prefix", 99, "s"), ("tail", 500, "s")], {"split_tail_still_oversized", "split_ratio_off"}),
    ([("prefix", 50, "s"), ("tail", 20, "t")], {"broken_split_pair"}),
    ([("prefix", 50, "s"), ("tail", 50, "s")], {"split_ratio_off"})])
def test_boundary_audit(spark, specs, codes):
    cfg = MemoryConfig(context_window=3667)  # threshold 99
    issues = segment.boundary_audit(frag(spark, *specs), cfg)
    assert {r.code for r in issues.select("code").distinct().collect()} == codes
    assert segment.audit_verdict(issues).first().ok == (codes <= {"split_ratio_off"})


@pytest.mark.parametrize("p,t,verdict", [(80, 20, "accept"), (99, 1, "reject"), (68, 32, "warn")])
def test_split_ratio(spark, p, t, verdict):
    assert one(spark, v=segment.split_ratio(F.lit("x" * p), F.lit("y" * t))["verdict"]).v == verdict


def test_split_ratio_of_an_empty_text_is_that_of_sql(spark, tmp_path):
    import duckdb
    import oracle
    from memlake import registry
    rows = [(0, ""), (1, "abc"), (2, None), (3, "x" * 200)]
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(path)
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{path}/*.parquet'")
    out = registry.queries()["split_ratio_check"](spark, str(tmp_path))
    assert oracle.compare(out, con, registry.oracle_sql()["split_ratio_check"]) is None
    assert {r.doc_id: r.verdict for r in out.collect()} == {0: "reject", 1: "reject", 2: "accept", 3: "reject"}


def test_split_keeps_the_text_and_the_ratio(spark):
    text = "".join(f"Sentence number {i} is here. " for i in range(200))
    f = spark.createDataFrame([("f", text)], "fragment_id string, content string")
    parts = {r.kind: r for r in segment.split_overlong(f).collect()}
    assert parts["prefix"].content + parts["tail"].content == text
    assert 0.7 <= len(parts["prefix"].content) / len(text) <= 0.9 and parts["prefix"].content.endswith(".")


def test_text_without_sentence_ends_stays_whole(spark):
    f = spark.createDataFrame([("f", "x" * 5000)], "fragment_id string, content string")
    assert [(r.kind, r.oversized) for r in segment.split_overlong(f).collect()] == [("whole", True)]


def test_leaf_evidence_target(spark):
    ev = spark.createDataFrame([("S", "x" * 10), ("S", "x" * 20)], "subset_id string, content_raw string")
    assert graph.leaf_evidence_stats(ev).first().target_len == 18


def test_abstract_event_gives_no_timeline_row(spark, sf):
    from memlake.mappings import Tables
    r = Tables(spark, sf).event_role.withColumn("is_abstract", F.lit(True))
    assert tl.timeline_update(r).isEmpty()


def test_event_whose_roles_have_no_entries_turns_silent(spark, sf):
    from memlake.mappings import Tables
    t = Tables(spark, sf)
    out = tl.silence_check(t.event_role, t.timeline.limit(0), t.as_of)
    assert out.filter("not is_silent").isEmpty()


def test_focus_roles_in_several_passes(spark, sf):
    from memlake.mappings import Tables
    from memlake.registry.timeline import focus_texts
    t = Tables(spark, sf)
    role = t.role.unionByName(spark.createDataFrame([("R-short", "he", "x", ["q"])], "role_id string, name string, entity_type string, aliases array<string>"))
    a = roles.focus_roles(focus_texts(t), role)
    b = roles.focus_roles(focus_texts(t), role, block_names=3)
    assert rows(a) == rows(b) and not a.isEmpty()
    odd = spark.createDataFrame([("q", "he said"), ("q", "she"), ("n", None), ("e", "")], "query_id string, text string")
    named = spark.createDataFrame([("R", "he", None), ("S", None, ["", "she"])], "role_id string, name string, aliases array<string>")
    for size in (1, 100):
        assert rows(roles.focus_roles(odd, named, block_names=size)) == [("q", "R"), ("q", "S")]
        assert rows(roles.focus_roles(odd, named, "C", block_names=size)) == [("e", "C"), ("n", "C"), ("q", "C"), ("q", "R"), ("q", "S")]


def test_chunks_join_to_the_document(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    pieces = corpus.corpus_chunk(docs, stops=".")
    back = {}
    for r in pieces.orderBy("doc_id", "id").collect():
        back[r.doc_id] = back.get(r.doc_id, "") + r.content
    assert back == {r.doc_id: r.text for r in docs.collect() if r.text}


# -- blocks ----------------------------------------------------------------------------
def test_block_stays_under_the_redline(spark):
    b = spark.createDataFrame([("q", f"e{i:02d}", float(-i), 117 - i) for i in range(15)], "query_id string, event_id string, score double, text_len int")
    assert recall.budget_prefix(b, 750).agg(F.max("used")).first()[0] <= 750


def test_first_text_too_long_is_compressed(spark):
    long = [["x" * 900, "x" * 400, "x" * 100], ["y" * 300, "y" * 80], ["z" * 10]]
    b = spark.createDataFrame([("q", f"e{i}", i + 1, [f"L{k + 1}" for k in range(len(t))], t) for i, t in enumerate(long)],
                              "query_id string, event_id string, position int, levels array<string>, texts array<string>")
    out = recall.block_compress(b, 500).orderBy("position").collect()
    assert sum(len(r.text) for r in out) <= 500 and out[0].event_id == "e0"


# -- search ----------------------------------------------------------------------------
def test_search_in_several_passes(spark, sf, monkeypatch):
    from memlake.mappings import Tables
    t = Tables(spark, sf)
    q = t.vector.select(F.col("event_id").alias("query_id"), "embedding")
    a = search.vector_topk(q, t.vector, 5).withColumn("score", F.round("score", 9))
    a = rows(a, "query_id", "event_id", "rank", "score")
    monkeypatch.setattr(search, "PASS_BYTES", 20_000)
    b = search.vector_topk(q, t.vector, 5).withColumn("score", F.round("score", 9))
    assert a == rows(b, "query_id", "event_id", "rank", "score")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_events_are_not_moved_by_search(spark, sf):
    from memlake.mappings import Tables
    t = Tables(spark, sf)
    for df in (search.vector_topk(t.vector_query, t.vector, 5), search.band_fusion(t.vector_query, t.vector, {"act": 1.0, "emo": 1.0, "ent": 1.0}, 5)):
        plan = plan_of(df).split("== Initial Plan ==")[-1]
        below = plan[plan.index("MapInPandas"):]
        assert plan.count("MapInPandas") == 1 and "Exchange" not in below and below.count("FileScan") == 1


def test_recall_reads_each_table_few_times(spark, sf):
    from memlake.registry import queries
    plan = plan_of(queries()["recall_block"](spark, sf)).split("== Initial Plan ==")[-1]
    assert plan.count("FileScan") <= 18


def test_vectors_without_direction_take_no_part(spark):
    schema = "event_id string, act array<double>, emo array<double>"
    v = spark.createDataFrame([("a", [1.0, 0.0], [0.0, 1.0]), ("z", [0.0, 0.0], [1.0, 0.0]), ("n", None, [1.0, 1.0]), ("h", [None, 1.0], None)], schema)
    q = v.withColumnRenamed("event_id", "query_id")
    assert rows(search.vector_topk(q, v, 9, "act"), "query_id", "event_id") == [("a", "a")]
    got = rows(search.band_fusion(q, v, {"act": 1.0, "emo": 1.0}, 9), "query_id", "event_id")
    assert len(got) == 9 and not any("h" in r for r in got)
    assert search.vector_topk(q.limit(0), v, 3, "act").isEmpty() and search.vector_topk(q, v.limit(0), 3, "act").isEmpty()


def test_a_far_hit_with_a_large_weight_is_not_cut(spark):
    h = spark.range(500).select(F.lit("q").alias("query_id"), F.format_string("e%03d", "id").alias("event_id"), (F.col("id") / 1000).alias("distance"),
                                F.when(F.col("id") == 450, 1e9).otherwise(0.0).alias("weight"), F.lit(0.0).alias("event_valence"), F.lit(0.0).alias("query_valence"))
    ranks = {r.event_id: r["rank"] for r in recall.rrf_single(h, MemoryConfig(factor_cap=1e9, factor_alpha=50.0)).collect()}
    assert ranks["e450"] == 451 and len(ranks) == 60


def test_a_name_of_very_many_roles(spark):
    many = spark.range(100_000).select(F.format_string("R%06d", "id").alias("role_id"), F.lit("Anna").alias("name"), F.array(F.lit("An")).alias("aliases"))
    texts = spark.createDataFrame([(f"q{i}", "ANNA came" if i < 3 else "nobody") for i in range(6)], "query_id string, text string")
    out = roles.focus_roles(texts, many, part_rows=3_000)
    assert out.count() == 300_000 and out.select("query_id").distinct().count() == 3
    few = many.limit(5)
    asked = spark.range(500).select(F.col("id").cast("string").alias("query_id"), F.lit("see anna").alias("text"))
    assert roles.focus_roles(asked, few, part_rows=2).count() == 2_500


def test_text_of_very_many_leaves_in_blocks(spark):
    leaves = spark.range(100_000).select(F.lit("A").alias("root"), F.format_string("E%06d", "id").alias("event_id"))
    entry = leaves.select("event_id", F.lit(0).alias("pos"), F.lit("R").alias("role_id"))
    role = spark.createDataFrame([("R", "Ann", None)], "role_id string, name string, aliases array<string>")
    event = spark.createDataFrame([("A",), ("none",)], "event_id string")
    out = {(r.event_id, r.block_no): r.entity_text for r in roles.entity_blocks(event, entry, role, leaves, block_chars=10_000).collect()}
    parts = [out[k] for k in sorted(out) if k[0] == "A"]
    assert max(map(len, parts)) <= 10_001 and len(parts) > 15 and out[("none", 0)] == "none"
    whole = {r.event_id: r.entity_text for r in roles.entity_text(event, entry, role, leaves).collect()}
    assert " ".join(parts) == whole["A"]


def test_text_blocks_in_many_slots_and_with_long_texts(spark):
    from memlake.operators.ordered import text_blocks
    texts = [("k", i, "x" * (25 if i == 3 else i % 4)) for i in range(12)] + [("k", 12, None), (None, 1, "lost"), ("z", 0, "")]
    df = spark.createDataFrame(texts, "key string, i int, t string")
    for slot in (2, 100):
        got = {(r["key"], r.block_no): r.text for r in text_blocks(df, ["key"], [F.col("i")], "t", 10, rows_per_slot=slot).collect()}
        assert " ".join(got[k] for k in sorted(got) if k[0] == "k") == " ".join(t for k, _, t in texts[:12])
        assert {k[0] for k in got} == {"k", "z"} and got[("z", 0)] == ""


def test_successors_in_blocks_append_to_blocks(spark):
    known = spark.createDataFrame([("P", ["b", "a"]), ("Q", ["x"])], "event_id string, successors array<string>")
    edges = spark.createDataFrame([("c", "P"), ("a", "P"), ("d", "P")], "event_id string, prefix_id string")
    first = graph.successor_blocks(edges, known, block=2)
    assert rows(first) == [("P", 0, ["b", "a"]), ("P", 1, ["c", "d"]), ("Q", 0, ["x"])]
    more = spark.createDataFrame([("e", "P"), ("c", "P")], "event_id string, prefix_id string")
    assert rows(graph.successor_blocks(more, first, block=2)) == [("P", 0, ["b", "a"]), ("P", 1, ["c", "d"]), ("P", 2, ["e"]), ("Q", 0, ["x"])]


def test_a_large_pool_equals_the_plain_top(spark, monkeypatch):
    from memlake.operators import sampling
    rows_ = [(f"e{i:03d}", (i * 37 % 50) / 50 + 0.001) for i in range(300)]
    df = spark.createDataFrame(rows_, "event_id string, sample_key double")
    want = sorted(e for e, _ in sorted(rows_, key=lambda r: (-r[1], r[0]))[:77])
    monkeypatch.setattr(sampling, "TOP_ROWS", 10)
    assert [r.event_id for r in sampling.active_pool(df, 77).orderBy("event_id").collect()] == want
    assert sampling.active_pool(df, 400).count() == 300 and sampling.active_pool(df.limit(0), 20).isEmpty()


def test_frequent_sets_in_many_parts(spark, monkeypatch):
    log = log_of(spark, [E6[:3 + i % 4] for i in range(24)] + [["rare", f"u{i}", *E6[:4]] for i in range(4)])
    plain = rows(mining.frequent_subsets(log, 3, 3))
    exact = lambda: rows(mining.closed_itemsets(log, F.lit(T0), 3, 3, 0.0, exact=True).select("subset", "txns"))
    closed = exact()
    monkeypatch.setattr(mining, "SETS_PER_PART", 1)
    assert rows(mining.frequent_subsets(log, 3, 3)) == plain and exact() == closed and plain


def test_equal_versions_are_decided_by_content(spark):
    a, b = (1, 5, "x"), (1, 5, "y")
    got = [lake.upsert_latest(spark.createDataFrame([p, (2, 1, "k")], "id int, version int, v string"), spark.createDataFrame([q], "id int, version int, v string"), ["id"], "version") for p, q in ((a, b), (b, a))]
    assert rows(got[0]) == rows(got[1]) and (2, 1, "k") in rows(got[0])


def test_hash_vector_matches_the_digest(spark):
    import hashlib
    seed = hashlib.sha256("héllo".encode()).digest()
    raw = [b / 255 * 2 - 1 for i in range(2) for b in hashlib.sha256(seed + i.to_bytes(4, "little")).digest()][:40]
    size = math.sqrt(sum(x * x for x in raw))
    got = one(spark, v=vectors.hash_embed(F.lit("héllo"), 40)).v
    assert got == pytest.approx([x / size for x in raw])


# -- ordered helpers over hot keys --------------------------------------------------------
def hot(spark, n=500):
    return spark.range(n).select(F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 7)).alias("k"), "id",
                                 (F.lit(T0) + F.make_dt_interval(mins=(F.col("id") * 37 % 5000).cast("int"))).alias("ts"), (F.col("id") % 11).alias("v"))


def test_slotted_running_total_equals_the_plain_window(spark):
    from pyspark.sql import Window
    df = hot(spark)
    w = Window.partitionBy("k").orderBy("ts", "id")
    want = rows(df.withColumn("t", F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0))), "id", "t")
    got = running_total(df, ["k"], [F.col("ts"), F.col("id")], F.col("v"), "t", rows_per_slot=40)
    assert rows(got, "id", "t") == want


def test_carried_rows_give_the_plain_frame(spark):
    from pyspark.sql import Window
    df = hot(spark)
    frame = lambda *keys: Window.partitionBy(*keys).orderBy("ts", "id").rowsBetween(-9, 0)
    want = rows(df.withColumn("t", F.sum("v").over(frame("k"))), "id", "t")
    slotted = with_preceding(df, ["k"], ["ts", "id"], 9, rows_per_slot=40)
    got = slotted.withColumn("t", F.sum("v").over(frame("k", "_slot"))).filter(~F.col("_carried"))
    assert rows(got, "id", "t") == want


def test_percentile_and_rank_without_gathering(spark):
    df = hot(spark).withColumn("x", F.col("id") * 0.37)
    want = {r.k: r.p for r in df.groupBy("k").agg(F.percentile("x", 0.9).alias("p")).collect()}
    got = {r.k: r.p for r in exact_percentile(df, ["k"], "x", 0.9, "p", rows_per_slot=60).collect()}
    assert got == pytest.approx(want)
    us = df.select(F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    ranked = sorted(r.us for r in us.collect())
    for at in (0, 123, len(ranked) - 1):
        assert value_at_rank(us, "us", lambda n: at) == ranked[at]
    assert value_at_rank(us, "us", lambda n: n) is None and value_at_rank(us.limit(0), "us", lambda n: 0) is None


def test_one_key_at_one_time_is_cut_into_slots(spark):
    from memlake.operators.ordered import SLOT
    df = spark.range(4000).select(F.lit("hot").alias("k"), F.lit(T0).alias("ts"), "id")
    slots = by_rows(df, ["k"], [F.col("ts"), F.col("id")], rows_per_slot=500).groupBy(SLOT).agg(F.count("*").alias("n"), F.min("id").alias("a"), F.max("id").alias("b")).orderBy(SLOT).collect()
    assert len(slots) > 4 and max(r.n for r in slots) < 1500 and all(x.b < y.a for x, y in zip(slots, slots[1:]))
    total = running_total(df, ["k"], [F.col("ts"), F.col("id")], F.lit(1), "t", rows_per_slot=500)
    assert total.filter("t <> id + 1").isEmpty()


def test_percentile_with_an_outlier_and_ties(spark):
    df = spark.createDataFrame([("a", float(i % 3)) for i in range(300)] + [("a", 1e12), ("b", None)], "k string, x double")
    got = exact_percentile(df, ["k"], "x", 0.5, "p", rows_per_slot=2).collect()
    assert [(r.k, r.p) for r in got] == [("a", 1.0)]


def test_rolling_mean_window_of_three(spark):
    s = spark.createDataFrame([("p", i, T0 + i * DAY, x) for i, x in enumerate((100.0, 200.0, 300.0, 400.0))],
                              "phase string, seq bigint, create_time timestamp_ntz, elapsed_ms double")
    out = monitor.perf_rolling_mean(s, MemoryConfig(perf_window=3)).orderBy("seq").collect()
    assert out[-1].mean_ms == 300.0


def test_recall_log_keeps_order_and_drops_repeats(spark):
    b = spark.createDataFrame([("q", "b", 1), ("q", "a", 2), ("q", "b", 3)], "query_id string, event_id string, position int")
    assert lake.recall_log_rows(b).first().event_ids == ["b", "a"]

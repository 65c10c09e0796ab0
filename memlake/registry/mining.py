"""Frequent sets and the subset bookkeeping around them."""

import re

from pyspark.sql import functions as F

from memlake.config import DEFAULT as CFG
from memlake.functions import text as tx
from memlake.mappings import AGE_DAYS, with_ctes
from memlake.operators import mining
from memlake.registry.core import query, r6
from memlake.sources import lake

_AGE = AGE_DAYS.format(a="created_at", b="(select t from clock)")
_SETS = f"select event_ids as items, count(*) as n, sum(exp(-0.01*{_AGE})) as w from recall_log group by event_ids"
_PAIRS = """select distinct s from (
  select list_sort(list_intersect(a.items, b.items)) as s from sets a join sets b on array_to_string(a.items,'|') < array_to_string(b.items,'|')
  union all select items from sets where n>1) where len(s)>=6"""
_CAND = """select distinct s from (select s from pairs union all
  select list_filter(s, lambda y: y<>x) from (select s, unnest(s) as x from pairs where len(s)>6))"""
_FOUND = "select s, sum(n)::bigint as txns, sum(w) as support from cand join sets on list_has_all(items, s) group by s having sum(w)+1e-6>=12"
_CLOSED = """select s, txns, support from found f where not exists (
  select 1 from found g where len(g.s)>len(f.s) and list_has_all(g.s, f.s) and abs(g.support-f.support)<1e-9)"""
_MINER = dict(sets=_SETS, pairs=_PAIRS, cand=_CAND, found=_FOUND, closed=_CLOSED)
JOIN = "array_to_string({},'|')"


def subset_sets(t):
    return mining.distinct_sets(t.recall_log, t.as_of, CFG.support_decay)


@query("txn_pair_intersect", with_ctes("select array_to_string(s,'|') as subset, len(s)::int as size from pairs",
                                       "recall_log", "clock", sets=_SETS, pairs=_PAIRS))
def txn_pair_intersect(t):
    out = mining.pair_intersections(subset_sets(t), CFG.min_size)
    return out.select(F.array_join("subset", "|").alias("subset"), F.size("subset").alias("size"))


@query("drop_one", with_ctes("""
    select recall_id, array_to_string(list_filter(event_ids, lambda y: y<>x),'|') as subset from (select recall_id, event_ids, unnest(event_ids) as x from recall_log)""",
    "recall_log"))
def drop_one(t):
    return t.recall_log.select("recall_id", F.explode(mining.drop_one(F.col("event_ids"))).alias("s")).select("recall_id", F.array_join("s", "|").alias("subset"))


@query("subset_support_join", with_ctes("""
    select array_to_string(a.items,'|') as subset, count(*) as sets, sum(b.n)::bigint as txns
    from sets a join sets b on list_has_all(b.items, a.items) group by a.items""", "recall_log", "clock", sets=_SETS))
def subset_support_join(t):
    sets = subset_sets(t)
    inside = mining.contained_in(sets.select(F.col("items").alias("subset")), sets).join(sets.select("sid", "n"), "sid")
    return inside.groupBy("subset").agg(F.count("*").alias("sets"), F.sum("n").alias("txns")).withColumn("subset", F.array_join("subset", "|"))


@query("decayed_support", with_ctes("""
    select array_to_string(a.items,'|') as subset, round(sum(b.w),6) as support from sets a join sets b on list_has_all(b.items, a.items) group by a.items""",
    "recall_log", "clock", sets=_SETS))
def decayed_support(t):
    sets = subset_sets(t)
    return mining.subset_support(sets.select(F.col("items").alias("subset")), sets).select(
        F.array_join("subset", "|").alias("subset"), r6("support", "support"))


@query("closed_itemsets", with_ctes("select array_to_string(s,'|') as subset, len(s)::int as size, txns, round(support,6) as support from closed",
                                    "recall_log", "clock", **_MINER))
def closed_itemsets(t):
    out = mining.closed_itemsets(t.recall_log, t.as_of, CFG.min_size, CFG.min_support, CFG.support_decay)
    return out.select(F.array_join("subset", "|").alias("subset"), F.size("subset").alias("size"), "txns", r6("support", "support"))


@query("frequent_subsets", "with recursive " + with_ctes("""
    select array_to_string(c.s,'|') as subset, sum(n)::bigint as support from closure c join sets on list_has_all(items, c.s) group by c.s having sum(n)>=12""",
    "recall_log", "clock", sets=_SETS, closure="""
      select items as s from sets where len(items)>=6
      union select list_sort(list_intersect(c.s, t.items)) from closure c join sets t on len(list_intersect(c.s, t.items))>=6""")[len("with "):])
def frequent_subsets(t):
    out = mining.frequent_subsets(t.recall_log, CFG.min_size, CFG.min_support)
    return out.select(F.array_join("subset", "|").alias("subset"), "support")


@query("fingerprint", with_ctes("select recall_id, array_to_string(list_sort(list_distinct(event_ids||event_ids)),'|') as fingerprint from recall_log", "recall_log"))
def fingerprint(t):
    return t.recall_log.select("recall_id", tx.fingerprint(F.concat("event_ids", F.reverse("event_ids"))).alias("fingerprint"))


@query("fired_anti", with_ctes("""
    select recall_id, array_to_string(event_ids,'|') as fingerprint from recall_log
    where array_to_string(event_ids,'|') not in (select array_to_string(event_ids,'|') from recall_log where recall_id like '%-0')""", "recall_log"))
def fired_anti(t):
    fired = t.recall_log.filter(F.col("recall_id").endswith("-0")).select(tx.fingerprint(F.col("event_ids")).alias("fingerprint")).distinct()
    return mining.fired_anti(t.recall_log.withColumnRenamed("event_ids", "subset"), fired).select("recall_id", "fingerprint")


@query("replace_subset", with_ctes("""
    select recall_id, list_has_all(event_ids, s) as changed, array_to_string(case when list_has_all(event_ids, s)
      then list_sort(list_filter(event_ids, lambda x: not list_contains(s, x))||['ABS-1']) else event_ids end,'|') as ids
    from (select *, ['click-0','view-1'] as s from recall_log)""", "recall_log"))
def replace_subset(t):
    out = mining.replace_subset(t.recall_log, F.array(F.lit("click-0"), F.lit("view-1")), F.lit("ABS-1"))
    return out.select("recall_id", "changed", F.array_join("event_ids", "|").alias("ids"))


_PARTS = """select recall_id, event_ids as s,
    case w when 0 then event_ids when 1 then event_ids[2:] when 2 then event_ids[1:2] when 3 then event_ids||['stranger'] else event_ids end as c,
    case w when 1 then event_ids[1:1] when 2 then event_ids[3:] when 4 then event_ids[1:1] when 5 then []::varchar[] else []::varchar[] end as x
  from (select *, (length(recall_id)+len(event_ids))%6 as w from recall_log)"""
_VALID = "(list_has_all(s, c||x) and len(list_intersect(c,x))=0 and list_has_all(c||x, s))"


def partitions(t):
    e = F.col("event_ids")
    w = (F.length("recall_id") + F.size(e)) % 6
    none = F.array().cast("array<string>")
    rest = lambda start: F.slice(e, F.lit(start), F.size(e))
    return t.recall_log.select(
        "recall_id", e.alias("subset"),
        F.when(w == 1, rest(2)).when(w == 2, F.slice(e, 1, 2)).when(w == 3, F.concat(e, F.array(F.lit("stranger")))).otherwise(e).alias("coherent"),
        F.when(w == 1, F.slice(e, 1, 1)).when(w == 2, rest(3)).when(w == 4, F.slice(e, 1, 1)).otherwise(none).alias("excluded"))


@query("coherence_gate", with_ctes(f"""
    select recall_id, {_VALID} as is_valid, round(case when {_VALID} then len(c)/len(s)::double else 0 end,6) as rate,
      {_VALID} and len(c)>=3 as passed, case when {_VALID} then array_to_string(c,'|') else '' end as kept from parts""", "recall_log", parts=_PARTS))
def coherence_gate(t):
    out = mining.coherence_gate(partitions(t))
    return out.select("recall_id", "is_valid", r6("rate", "rate"), "passed", F.array_join("kept", "|").alias("kept"))


@query("relevance_rate", with_ctes(f"select recall_id, round(case when {_VALID} then len(c)/len(s)::double else 0.5 end,6) as rate from parts", "recall_log", parts=_PARTS))
def relevance_rate(t):
    return mining.relevance_rate(partitions(t)).select("recall_id", r6("rate", "rate"))


@query("insight_text", with_ctes("""
    select event_id, case k%4 when 0 then '[CAUSALITY] '||event_type when 1 then '[MERONYMY] '||event_type end as insight from event""", "event"))
def insight_text(t):
    k = F.col("k") % 4
    rel = F.when(k == 0, "causality").when(k == 1, "MERONYMY").when(k == 2, "made up")
    return t.event.select("event_id", tx.insight(rel, F.col("event_type")).alias("insight"))


_BASKET_PAIRS = """select distinct s from (select list_sort(list_intersect(a.items, b.items)) as s
  from sets a join sets b on a.items<b.items where len(list_intersect(a.items, b.items))>=4 union all select items from sets where n>1 and len(items)>=4)"""


@query("mine_round", with_ctes("""
    select 'ABS-'||md5(array_to_string(s,'|')) as abstract_id, array_to_string(s,'|') as members, round(support,6) as support, 1 as round
    from closed order by len(s) desc, round(closed.support,9) desc, array_to_string(s,'|') limit 1""", "recall_log", "clock",
    **{**_MINER, "sets": f"""select event_ids as items, count(*) as n, sum(exp(-0.01*{_AGE})) as w
      from (select * from (select * from recall_log order by created_at desc, recall_id desc limit 1000) where len(event_ids)>=6) group by event_ids"""}))
def mine_round(t):
    from memlake.plans.mine import mine_abstracts
    none = t.spark.createDataFrame([], "fingerprint string, abstract_event_id string")
    out = mine_abstracts(t.recall_log, none, t.as_of, max_rounds=1).abstract
    return out.select("abstract_id", F.array_join("members", "|").alias("members"), r6("support", "support"), "round")


ROUNDS = 26  # as many as the SQL below is written out for; a table that needs more would show as a difference


def _rounds() -> dict[str, str]:
    """The loop written out: recent rows, their sets, the closed set that is taken, and the rows after it."""
    out = {"r1": "select * from recall_log order by created_at desc, recall_id desc limit 1000"}
    for i in range(1, ROUNDS + 1):
        support = CFG.escalated_support if i - 1 > CFG.escalate_after else CFG.min_support
        names = {k: f"{k}{i}" for k in ("sets", "pairs", "cand", "found", "closed")}
        own = {"sets": f"select event_ids as items, count(*) as n, sum(exp(-0.01*{_AGE})) as w from r{i} where len(event_ids)>=6 group by event_ids",
               "pairs": _PAIRS, "cand": _CAND, "found": _FOUND.replace(">=12", f">={support}"), "closed": _CLOSED}
        for k, sql in own.items():
            for old, new in names.items():
                sql = re.sub(rf"\b(from|join) {old}\b", rf"\1 {new}", sql)
            out[names[k]] = sql
        out[f"pick{i}"] = f"""select 'ABS-'||md5(array_to_string(s,'|')) as abstract_id, s as members, support, {i} as round
            from closed{i} order by len(s) desc, round(support,9) desc, array_to_string(s,'|') limit 1"""
        out[f"r{i + 1}"] = f"""select recall_id, created_at, case when p.members is not null and list_has_all(event_ids, p.members)
            then list_sort(list_distinct(list_filter(event_ids, lambda x: not list_contains(p.members, x))||[p.abstract_id])) else event_ids end as event_ids
            from r{i} left join pick{i} p on true"""
    out["made"] = " union all ".join(f"select * from pick{i}" for i in range(1, ROUNDS + 1))
    return out


def mined(t):
    from memlake.plans.mine import mine_abstracts
    none = t.spark.createDataFrame([], "fingerprint string, abstract_event_id string")
    return mine_abstracts(t.recall_log, none, t.as_of)


@query("mine_abstracts", with_ctes(f"""
    select abstract_id, array_to_string(members,'|') as members, round(support,6) as support, round,
      (select count(*) from r{ROUNDS + 1} where list_contains(event_ids, abstract_id)) as log_rows from made""", "recall_log", "clock", **_rounds()))
def mine_abstracts_(t):
    out = mined(t)
    newest = lake.newest(t.recall_log, CFG.recent_k, ["created_at", "recall_id"]).select("recall_id")
    per = out.log.join(newest, "recall_id", "left_semi").select(F.explode("event_ids").alias("abstract_id")).groupBy("abstract_id").agg(F.count("*").alias("log_rows"))
    return out.abstract.join(per, "abstract_id", "left").select(
        "abstract_id", F.array_join("members", "|").alias("members"), r6("support", "support"), "round", F.coalesce("log_rows", F.lit(0)).alias("log_rows"))


@query("mine_effects", "with recursive " + with_ctes("""
    select node as event_id, round(least(sum(1.0::double/(1+ln(n))), 3.0::double),6) as abstract_coverage, node not like 'ABS-%' and bool_or(direct) as marked,
      coalesce(any_value(lev.level), 0)::int as level
    from (select root, node, direct, count(*) over (partition by root) as n from touched) left join lev on lev.event_id=node group by node""",
    "recall_log", "clock", **_rounds(),
    e="select abstract_id as parent, unnest(members) as child from made",
    walk="select parent as root, child as node, 1 as depth from e union select w.root, e.child, w.depth+1 from walk w join e on w.node=e.parent",
    touched="select root, node, bool_or(depth=1) as direct from walk where depth=1 or node not like 'ABS-%' group by root, node",
    lev="select root as event_id, max(depth) as level from walk group by root")[5:])
def mine_effects(t):
    from memlake.functions import vectors
    from memlake.plans.mine import effects
    out = mined(t)
    items = t.recall_log.select(F.explode("event_ids").alias("event_id")).distinct()
    nodes = items.select("event_id", F.lit(False).alias("is_abstract"), F.lit(0).alias("level"), t.as_of.alias("create_time"),
                         F.col("event_id").alias("content_raw"), F.lit(False).alias("is_tombstoned"), F.lit(False).alias("ptsd_immune"))
    edges = t.spark.createDataFrame([], "parent string, child string")
    acts = items.select("event_id", vectors.hash_embed(F.col("event_id"), 32).alias("act"))
    done = effects(out, nodes, edges, items.withColumn("abstract_coverage", F.lit(0.0)), items.withColumn("asf", F.lit(0.0)), acts, t.as_of, 32)
    marked = done.marked.withColumn("marked", F.lit(True))
    level = done.event.select(F.col("abstract_id").alias("event_id"), F.col("abstraction_level").alias("level"))
    return done.coverage.filter("abstract_coverage > 0").join(marked, "event_id", "left").join(level, "event_id", "left").select(
        "event_id", r6("abstract_coverage", "abstract_coverage"), F.coalesce("marked", F.lit(False)).alias("marked"), F.coalesce("level", F.lit(0)).alias("level"))

"""Health, quality and run reports."""

from pyspark.sql import Window, functions as F

from memlake.config import DEFAULT as CFG
from memlake.functions import scoring
from memlake.mappings import with_ctes
from memlake.operators import monitor, recall, sampling, segment, timeline as tl
from memlake.registry.core import query, r6
from memlake.registry.search import _KEYS, _RRF, tier1

_LIMIT = "case phase when 'rag_search' then 200 when 'recall_assembly' then 500 when 'abstraction_mining' then 2000 when 'narrative_dedupe' then 300 else 200 end::double"
_STATE = f"""select phase, avg(elapsed_ms)/({_LIMIT}) as overload from (select *, row_number() over (partition by phase order by seq desc) as rn from phase_sample)
  where rn<=32 group by phase"""
_LOADS = """select greatest(1.0,least(4.0,max(overload))) as g, greatest(1.0,least(4.0,coalesce(max(overload) filter (where phase in ('rag_search','recall_assembly')),1.0))) as r,
  greatest(1.0,least(4.0,coalesce(max(overload) filter (where phase in ('abstraction_mining','narrative_dedupe')),1.0))) as a from state"""


@query("perf_rolling_mean", with_ctes(f"""
    select phase, seq, round(m,9) as mean_ms, round(m/({_LIMIT}),12) as overload from (
      select *, avg(elapsed_ms) over (partition by phase order by seq rows 31 preceding) as m from phase_sample)""", "phase_sample"))
def perf_rolling_mean(t):
    return monitor.perf_rolling_mean(t.phase_sample).select(
        "phase", "seq", F.round("mean_ms", 9).alias("mean_ms"), F.round("overload", 12).alias("overload"))


@query("load_factor", with_ctes("select round(g,6) as load_global, round(r,6) as load_recall, round(a,6) as load_abstract from loads",
                                "phase_sample", state=_STATE, loads=_LOADS))
def load_factor(t):
    return monitor.load_factors(t.phase_sample).select(*[r6(c, c) for c in ("load_global", "load_recall", "load_abstract")])


@query("load_adjusted_limit", with_ctes("""
    select round(r,6) as load_recall, round(a,6) as load_abstract, greatest(20000, floor(100000-80000*(r-1)/3))::bigint as pool_limit,
      greatest(200, floor(1000-800*(a-1)/3))::bigint as recent_k from loads""", "phase_sample", state=_STATE, loads=_LOADS))
def load_adjusted_limit(t):
    return monitor.load_limits(t.phase_sample).select(r6("load_recall", "load_recall"), r6("load_abstract", "load_abstract"), "pool_limit", "recent_k")


@query("quality_ema", "with recursive " + with_ctes("""
    select user_id, event_id, round(e,6) as ema_relevance from walk""", "event",
    num="select user_id, event_id, k/80::double as r, row_number() over (partition by user_id order by create_time, event_id) as rn from event",
    walk="""select user_id, event_id, rn, least(greatest(r,0),1)::double as e from num where rn=1
      union all select n.user_id, n.event_id, n.rn, 0.25*least(greatest(n.r,0),1)+0.75*w.e from walk w join num n on n.user_id=w.user_id and n.rn=w.rn+1""")[5:])
def quality_ema(t):
    rates = t.event.withColumn("rate", F.col("k") / 80)
    return monitor.quality_ema(rates, "user_id", ["create_time", "event_id"], "rate", "ema").select("user_id", "event_id", r6("ema", "ema_relevance"))


@query("invocation_stats", with_ctes("""
    select task_type, model, count(*) as calls, round(avg(latency_ms),6) as mean_ms, min(latency_ms) as min_ms, max(latency_ms) as max_ms,
      sum(prompt_tokens)::bigint as prompt_tokens, sum(completion_tokens)::bigint as completion_tokens
    from invocation group by rollup(task_type, model)""", "invocation"))
def invocation_stats(t):
    return monitor.invocation_stats(t.invocation).withColumn("mean_ms", F.round("mean_ms", 6))


@query("trace_summary", with_ctes("""
    select event_type as step, count(distinct user_id) as runs, round(sum(value),6) as elapsed_ms, sum(k)::bigint as calls, sum(n%500)::bigint as tokens
    from event group by event_type""", "event"))
def trace_summary(t):
    trace = t.event.select(F.col("event_type").alias("step"), F.col("user_id").alias("run_id"), F.col("value").alias("elapsed_ms"),
                           F.col("k").alias("calls"), (F.col("n") % 500).alias("tokens"))
    return monitor.trace_summary(trace).withColumn("elapsed_ms", F.round("elapsed_ms", 6))


@query("recall_trace", with_ctes("""
    select query_id, count(*) as hits, count(*) filter (where route=0) as route0, count(*) filter (where route=1) as route1, count(*) filter (where route=2) as route2,
      max(weight) as max_weight, min(distance) as min_distance, string_agg(event_id,'|' order by distance, event_id) filter (where rn<=20) as top_ids
    from (select *, row_number() over (partition by query_id order by distance, event_id) as rn from hits) group by query_id""", "hits"))
def recall_trace(t):
    return monitor.recall_trace(t.hits)


@query("chunk_snapshot", with_ctes("""
    select (select count(*) from event) as events, (select count(*) from event where n%5<>0) as events_new, (select count(*) from role) as roles,
      (select count(*) from graph_node where is_abstract) as abstracts, (select least(count(*),100000) from event where not is_tombstoned and status<>'silent') as pool_size,
      (select count(*) from recall_log) as log_rows, (select count(distinct conv_id) from turns) as unclosed,
      (select sum(length(text)+1)-count(distinct conv_id) from turns)::bigint as shadow_chars""", "event", "role", "graph_node", "recall_log", "turns"))
def chunk_snapshot(t):
    from memlake.plans.report import chunk_snapshot as op
    return op(t.event, t.role, t.graph_node, t.recall_log, t.turn)


@query("invariant_probes", with_ctes("""
    select probe, rows, broken, case when rows=0 then 'info' when broken=0 then 'pass' else 'fail' end as outcome from (
      select 'event_length' as probe, count(*) as rows, count(*) filter (where length(text)>2000) as broken from documents
      union all select 'summary_fuse', count(*), count(*) filter (where length(s3)<=35 and s4 is not null and length(s3)<length(content_raw)) from event_text
      union all select 'keyword_coverage', count(*), count(*) filter (where
          (contains(lower(text),'the')::int+contains(lower(text),'der')::int+contains(lower(text),'le')::int+contains(lower(text),'que')::int)<2) from documents
      union all select 'timeline_tier', count(*), count(*) filter (where importance in ('S','A') and n%2=0 and not contains(role_summary,'decided')) from timeline
      union all select 'block_budget', count(*), count(*) filter (where total>20000) from (select query_id, max(used) as total from (
          select query_id, (sum(text_len) over w)::bigint as used, row_number() over w as p from scored where text_len>0
          window w as (partition by query_id order by score desc, event_id rows unbounded preceding)) where used<=20000 or p=1 group by query_id)
      union all select 'tombstone_exclusion', count(*), count(*) filter (where is_tombstoned or status='silent') from scored join event using (event_id) where not is_tombstoned and status<>'silent'
      union all select 'level_chain', count(*), count(*) filter (where p.level<>c.level+1) from graph_edge x join graph_node p on p.event_id=x.parent join graph_node c on c.event_id=x.child
      union all select 'activation_range', count(*), count(*) filter (where a<0 or a>1) from (select event_id, least(max(arousal),1.0) as a from event_role group by event_id)
      union all select 'passive_silence', count(*), count(*) filter (where role<>'system' and text is null) from turns
      union all select 'retention_order', 1, (case when (select avg(memory_weight) from timeline where memory_weight>=0.5) > (select avg(memory_weight) from timeline where memory_weight<0.5) then 0 else 1 end))""",
    "event_text", "timeline", "hits", "graph_node", "graph_edge", "turns", "event_role", scored=_RRF))
def invariant_probes(t):
    from memlake.plans.report import invariant_probes as op
    return op(t)

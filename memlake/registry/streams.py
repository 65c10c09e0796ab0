"""Streaming jobs run to the end of the given tables."""

from pyspark.sql import functions as F

from memlake.config import DEFAULT as CFG
from memlake.mappings import Tables, with_ctes
from memlake.registry.core import query, r6
from memlake.streaming import jobs, processors, state


def live(t: Tables, order: str = "ts") -> Tables:
    """The same mappings over the events as a stream of three micro-batches in the given order."""
    key = F.unix_micros(F.col("ts").cast("timestamp")) if order == "ts" else F.col(order)

    class Live(Tables):
        def raw(self, name):
            return jobs.in_batches(t.raw(name), key, jobs.scratch(t.spark, name)) if name == "events" else t.raw(name)
    return Live(t.spark, t.path, t.cfg)


def event_stream(t: Tables):
    return live(t).raw("events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("stream_windows", with_ctes("""
    select epoch_us(time_bucket(interval 1 hour, ts)) as start_us, event_type, count(*) as n from events group by all"""))
def stream_windows(t):
    src = event_stream(t)
    rows = jobs.drain(jobs.window_counts(src, "ts", "event_type", "1 hour"), jobs.scratch(t.spark, "windows"), "update")
    return jobs.latest(rows, ["window_start", "event_type"]).select(F.unix_micros("window_start").alias("start_us"), "event_type", "n")


@query("stream_windows_sliding", """
    select epoch_us(time_bucket(interval 1 hour, ts) - to_hours(i)) as start_us, event_type, count(*) as n from events, (values (0),(1)) v(i) group by all""")
def stream_windows_sliding(t):
    src = event_stream(t)
    rows = jobs.drain(jobs.window_counts(src, "ts", "event_type", "2 hours", "1 hour"), jobs.scratch(t.spark, "sliding"), "update")
    return jobs.latest(rows, ["window_start", "event_type"]).select(F.unix_micros("window_start").alias("start_us"), "event_type", "n")


@query("stream_dedupe", "select event_id, value from events")
def stream_dedupe(t):
    src = event_stream(t)
    again = event_stream(t)
    rows = jobs.drain(jobs.dedupe(src.union(again), "event_id", "ts"), jobs.scratch(t.spark, "dedupe"))
    return rows.select("event_id", "value")


_SEAL = CFG.force_threshold
_PARTS = f"""select n.conv_id, n.turn, n.ts, n.text, n.rn, 1::bigint as session_no, 0 as part, length(n.text)::bigint as chars from num n where rn=1
  union all select n.conv_id, n.turn, n.ts, n.text, n.rn,
    case when epoch_us(n.ts)-epoch_us(w.ts)>1800000000 then w.session_no+1 else w.session_no end,
    case when epoch_us(n.ts)-epoch_us(w.ts)>1800000000 then 0 when w.chars+1+length(n.text)>{_SEAL} then w.part+1 else w.part end,
    case when epoch_us(n.ts)-epoch_us(w.ts)>1800000000 or w.chars+1+length(n.text)>{_SEAL} then length(n.text) else w.chars+1+length(n.text) end::bigint
  from parts w join num n on n.conv_id=w.conv_id and n.rn=w.rn+1"""
_FRAGMENTS = f"""select conv_id, session_no, part, count(*) as turns, epoch_us(min(ts)) as start_us, epoch_us(max(ts)) as end_us,
    string_agg(text, chr(10) order by ts, turn) as content,
    case when exists (select 1 from parts q where q.conv_id=p.conv_id and q.session_no=p.session_no and q.part>p.part) then 'force'
      when exists (select 1 from parts q where q.conv_id=p.conv_id and q.session_no>p.session_no) then 'gap'
      when epoch_us(max(ts)) + 24*3600000000 <= (select epoch_us(max(ts)) from turns) - 3600000000 then 'stale' end as closed_by
  from parts p group by conv_id, session_no, part"""
_SPANS = dict(num="select *, row_number() over (partition by conv_id order by ts, turn) as rn from turns", parts=_PARTS, fragments=_FRAGMENTS)


def turn_batches(t):
    turns = t.turn.withColumn("ts", F.col("ts").cast("timestamp"))
    return jobs.in_batches(turns, F.unix_micros("ts"), jobs.scratch(t.spark, "turns"))


@query("stream_unclosed", "with recursive " + with_ctes(f"""
    select conv_id, session_no, part, turns, start_us, end_us, md5(content) as content_md5, closed_by, length(content)>{_SEAL} as oversized
    from fragments where closed_by is not null""", "turns", **_SPANS)[5:])
def stream_unclosed(t):
    rows = jobs.drain(processors.unclosed_fragments(turn_batches(t).withWatermark("ts", jobs.WATERMARK), 30), jobs.scratch(t.spark, "unclosed"))
    return rows.filter(F.col("closed_by") != processors.ACCEPTED).select(
        "conv_id", "session_no", "part", "turns", "start_us", "end_us", F.md5("content").alias("content_md5"), "closed_by", "oversized")


_SPAN = "(select epoch_us(min(ts)) from turns)"
_BATCH = f"((epoch_us(ts)-{_SPAN})*3)//((select epoch_us(max(ts)) from turns)-{_SPAN}+1)"


def ingested(t):
    out = jobs.scratch(t.spark, "ingest")
    jobs.ingest(turn_batches(t), out).awaitTermination()
    return {name: t.spark.read.parquet(f"{out}/{name}") for name in ("event", "stale", "accepted", "recall_log")}


@query("stream_ingest", "with recursive " + with_ctes("""
    select conv_id, session_no, part, turns, least(length(content),2000)::int as event_length, closed_by, part as prefixes from fragments where closed_by in ('gap','force')
    union all select conv_id, session_no, part, turns, -1, 'stale', 0 from fragments where closed_by='stale'
    union all select conv_id, -1, 0, count(*), -1, 'accepted', 0 from turns group by conv_id""", "turns", **_SPANS)[5:])
def stream_ingest(t):
    tables = ingested(t)
    events = tables["event"].select("conv_id", "session_no", "part", "turns", "event_length", "closed_by", F.size("split_prefix_event_ids").alias("prefixes"))
    stale = tables["stale"].select("conv_id", "session_no", "part", "turns", F.lit(-1).alias("event_length"), "closed_by", F.lit(0).alias("prefixes"))
    taken = tables["accepted"].groupBy("conv_id").agg(F.count("*").alias("turns")).select(
        "conv_id", F.lit(-1).cast("bigint").alias("session_no"), F.lit(0).alias("part"), "turns", F.lit(-1).alias("event_length"), F.lit("accepted").alias("closed_by"), F.lit(0).alias("prefixes"))
    return events.unionByName(stale).unionByName(taken)


@query("stream_recall_log", "with recursive " + with_ctes("""
    select a.conv_id, count(*)::int as events, string_agg(session_no||'.'||part, ' ' order by start_us desc, part desc) as newest_first, count(distinct (session_no, part))::int as kinds
    from (select distinct conv_id, batch from placed) a join sealed s on s.conv_id=a.conv_id and s.batch<=a.batch group by a.conv_id, a.batch""", "turns", **_SPANS,
    placed=f"select *, {_BATCH} as batch from parts",
    sealed="""select f.conv_id, f.session_no, f.part, f.start_us, min(p.batch) as batch from fragments f join placed p on p.conv_id=f.conv_id
        and (p.session_no>f.session_no or (p.session_no=f.session_no and p.part>f.part)) where closed_by in ('gap','force') group by all""")[5:])
def stream_recall_log(t):
    tables = ingested(t)
    names = tables["event"].select("event_id", "conv_id", F.concat_ws(".", "session_no", "part").alias("name"))
    rows = tables["recall_log"].select("recall_id", F.posexplode("event_ids").alias("at", "event_id")).join(names, "event_id")
    listed = F.array_sort(F.collect_list(F.struct("at", "name")))
    return rows.groupBy("recall_id", "conv_id").agg(F.count("*").cast("int").alias("events"), F.array_join(F.transform(listed, lambda s: s["name"]), " ").alias("newest_first"),
                                                    F.count_distinct("name").cast("int").alias("kinds")).drop("recall_id")


@query("stream_rolling_affect", with_ctes("""
    select role_id, epoch_us(max(m)) as last_us, round(sum(valence*w)/sum(w),6) as rolling_valence, round(sum(arousal*w)/sum(w),6) as rolling_arousal,
      round(sum(arousal*w),6) as energy, count(*) as rows
    from (select *, exp(-0.1*(epoch_us(m)-epoch_us(create_time))/3600e6) as w from (select *, max(create_time) over (partition by role_id) as m from event_role))
    group by role_id""", "event_role"))
def stream_rolling_affect(t):
    entries = live(t).event_role.select("role_id", "create_time", "arousal", "valence")
    rows = jobs.drain(state.rolling_affect(entries), jobs.scratch(t.spark, "affect"), "update")
    return jobs.latest(rows, ["role_id"]).select("role_id", "last_us", r6("rolling_valence", "rolling_valence"),
                                                 r6("rolling_arousal", "rolling_arousal"), r6("energy", "energy"), "rows")


@query("stream_perf", with_ctes("""
    select phase, max(seq) as last_seq, round(avg(elapsed_ms),6) as mean_ms, count(*)::int as samples from (
      select *, row_number() over (partition by phase order by seq desc) as rn from phase_sample) where rn<=32 group by phase""", "phase_sample"))
def stream_perf(t):
    rows = jobs.drain(processors.perf_window(live(t).phase_sample.select("phase", "seq", "elapsed_ms")), jobs.scratch(t.spark, "perf"), "update")
    return jobs.latest(rows, ["phase"]).select("phase", "last_seq", r6("mean_ms", "mean_ms"), "samples")


@query("stream_bypass_limit", "with recursive " + with_ctes("""
    select source, query_id, asked_us from walk where granted""", "event",
    num="""select 'S-'||(user_id%7) as source, event_id as query_id, epoch_us(create_time) as asked_us,
        row_number() over (partition by user_id%7 order by create_time, event_id) as rn from event where value/500<0.5""",
    walk="""select source, query_id, asked_us, rn, asked_us as start_us, true as granted from num where rn=1
      union all select n.source, n.query_id, n.asked_us, n.rn, case when n.asked_us-w.start_us>60000000 then n.asked_us else w.start_us end,
        n.asked_us-w.start_us>60000000 from walk w join num n on n.source=w.source and n.rn=w.rn+1""")[5:])
def stream_bypass_limit(t):
    asks = live(t).event.select(F.concat(F.lit("S-"), F.col("user_id") % 7).alias("source"), F.col("event_id").alias("query_id"),
                                          F.col("create_time").alias("asked_at"), (F.col("value") / 500).alias("best_score"))
    rows = jobs.drain(state.bypass_limit(asks), jobs.scratch(t.spark, "bypass"))
    return rows.select("source", "query_id", "asked_us")


@query("stream_quality_ema", "with recursive " + with_ctes("""
    select user_id::varchar as source, seq as last_seq, round(a,6) as ema_a, round(b,6) as ema_b from walk
    qualify row_number() over (partition by user_id order by rn desc)=1""", "event",
    num="select user_id, n as seq, (n%100)/100::double as ra, k/100::double as rb, row_number() over (partition by user_id order by n) as rn from event",
    walk="""select user_id, seq, rn, ra as a, rb as b from num where rn=1
      union all select n.user_id, n.seq, n.rn, 0.25*n.ra+0.75*w.a, 0.25*n.rb+0.75*w.b from walk w join num n on n.user_id=w.user_id and n.rn=w.rn+1""")[5:])
def stream_quality_ema(t):
    rates = live(t, "event_id").event.select(F.col("user_id").cast("string").alias("source"), F.col("n").alias("seq"),
                                           ((F.col("n") % 100) / 100).alias("rate_a"), (F.col("k") / 100).alias("rate_b"))
    rows = jobs.drain(state.quality_ema(rates), jobs.scratch(t.spark, "quality"), "update")
    return jobs.latest(rows, ["source"]).select("source", "last_seq", r6("ema_a", "ema_a"), r6("ema_b", "ema_b"))

"""Affect, forgetting, roles and timelines."""

from pyspark.sql import functions as F

from memlake.config import DEFAULT as CFG, EMOTIONS
from memlake.functions import affect, ids, libm, scoring, vectors
from memlake.mappings import AGE_DAYS, scalar, with_ctes
from memlake.operators import monitor, roles, timeline as tl
from memlake.registry.core import query, r6, us
from memlake.sources import buckets
from memlake.streaming.jobs import scratch

_ASOF = "(select t from clock)"
_EFF = ("case when forgetting_factor=0 then 1.0 else forgetting_factor end*exp(-0.693*"
        + AGE_DAYS.format(a="last_accessed_time", b=_ASOF) + "/60.0)")
_RET = "exp(-0.693*" + AGE_DAYS.format(a="create_time", b=_ASOF) + "/60.0)"


_STANDING = with_ctes("""
    select r.role_id, r.event_id, round(t.forgetting_factor,6) as forgetting_factor, t.event_id is null as is_forgotten
    from event_role r left join (select * from timeline where importance<>'D') t using (role_id, event_id)""", "event_role", "timeline")


@query("event_role_timeline_join", _STANDING)
def event_role_timeline_join(t):
    out = tl.role_timeline_join(t.event_role, t.timeline.filter("importance <> 'D'"))
    return out.select("role_id", "event_id", r6("forgetting_factor", "forgetting_factor"), "is_forgotten")


@query("event_role_timeline_buckets", _STANDING)
def event_role_timeline_buckets(t):
    keys = ["role_id", "event_id"]
    roles_ = buckets.create(t.event_role.select(*keys, "importance"), scratch(t.spark, "event-role"), keys, 16)
    entries = buckets.create(t.timeline.filter("importance <> 'D'").select(*keys, "forgetting_factor", "memory_weight", "last_accessed_time"), scratch(t.spark, "timeline"), keys, 16)
    out = tl.role_timeline_join(roles_.table(), entries.table())
    return out.select("role_id", "event_id", r6("forgetting_factor", "forgetting_factor"), "is_forgotten")


@query("conflict_pairs", with_ctes("""
    select a.role_id, a.event_id as event_a, b.event_id as event_b, left(a.role_summary,80) as summary_a,
      left(b.role_summary,80) as summary_b, round(abs(a.valence-b.valence),3) as sentiment_delta
    from f a join f b on a.role_id=b.role_id and a.rn<b.rn where a.valence*b.valence < -0.2""", "timeline",
    f="select * from (select *, row_number() over (partition by role_id order by create_time, event_id) as rn from timeline) where rn<=50"))
def conflict_pairs(t):
    return tl.conflict_pairs(t.timeline)


@query("event_affect", with_ctes("""
    select event_id, round(least(max(arousal),1.0),6) as affective_energy, round(avg(valence),6) as event_valence
    from event_role group by event_id""", "event_role"))
def event_affect(t):
    out = tl.event_affect(t.event, t.event_role)
    return out.select("event_id", r6("affective_energy", "affective_energy"), r6("event_valence", "event_valence"))


@query("activation_energy", with_ctes(
    "select event_id, round(least(max(arousal*1.7),1.0),6) as activation_energy from event_role group by event_id", "event_role"))
def activation_energy(t):
    out = tl.activation_energy(t.event_role.withColumn("energy", F.col("arousal") * 1.7))
    return out.select("event_id", r6("activation_energy", "activation_energy"))


@query("emo_band_features", with_ctes(
    "select event_id, round(avg(valence),6) as valence, round(max(arousal),6) as arousal, round(sum(arousal),6) as energy, "
    + ", ".join(f"round(max({e}),6) as {e}" for e in EMOTIONS) + " from event_role group by event_id", "event_role"))
def emo_band_features(t):
    out = tl.emo_features(t.event_role.withColumn("energy", F.col("arousal")))
    return out.select("event_id", *[r6(c, c) for c in ("valence", "arousal", "energy", *EMOTIONS)])


@query("query_valence", with_ctes("""
    select q.query_id, round(coalesce(avg(r.valence),0),6) as valence
    from (select distinct 'Q-'||user_id as query_id, 'ROL-U'||(user_id*2) as role_id from event) q
    left join event_role r using (role_id) group by q.query_id""", "event", "event_role"))
def query_valence(t):
    q = t.event.select("user_id").distinct().select(
        F.concat(F.lit("Q-"), "user_id").alias("query_id"), F.concat(F.lit("ROL-U"), F.col("user_id") * 2).alias("role_id"))
    return roles.query_valence(q, q, t.event_role).select("query_id", r6("valence", "valence"))


@query("role_text_volume", with_ctes("""
    select role_id, sum(length(role_summary))::bigint as chars, sum(length(role_summary))>20000 as over_capacity
    from timeline group by role_id""", "timeline"))
def role_text_volume(t):
    return tl.role_text_volume(t.timeline)


_WEIGHT = f"""select event_id, case when im then 300.0 else coalesce(max(eff) filter (where rk=top),0.0) end as w_i from (
      select r.event_id, r.rank as rk, max(r.rank) over (partition by r.event_id) as top, {_EFF} as eff,
        max(r.arousal) over (partition by r.event_id) > 0.8 as im
      from event_role r left join timeline t on t.role_id=r.role_id and t.event_id=r.event_id) group by event_id, im"""
_WEIGHT = _WEIGHT.replace("create_time", "t.create_time")


def user_abstracts(t):
    """(root, event_id): an abstract event for each user over a third of the user's events."""
    return t.event.filter("n % 3 = 0").select(F.concat(F.lit("ABS-"), "user_id").alias("root"), "event_id")


_ABSTRACT_WEIGHT = "select 'ABS-'||user_id as event_id, coalesce(max(w_i),0) as w_i from event left join weight using (event_id) where n%3=0 group by user_id"


@query("event_weight", with_ctes("select event_id, round(w_i,6) as w_i from (select event_id, w_i from weight union all select event_id, w_i from raised)",
                                 "event", "event_role", "timeline", "clock", weight=_WEIGHT, raised=_ABSTRACT_WEIGHT))
def event_weight(t):
    return tl.event_weight(t.event_role, t.timeline, t.as_of, leaves=user_abstracts(t)).select("event_id", r6("w_i", "w_i"))


@query("w_eff", with_ctes("""
    select event_id, round(greatest(w_i*(1-least(greatest(asf,0),0.999999)),1e-6),6) as w_eff
    from weight join (select event_id, (n%130)/97::double-0.1::double as asf from event) using (event_id)""",
    "event", "event_role", "timeline", "clock", weight=_WEIGHT))
def w_eff(t):
    asf = t.event.select("event_id", ((F.col("n") % 130) / 97.0 - 0.1).alias("asf"))
    return tl.event_weight(t.event_role, t.timeline, t.as_of).join(asf, "event_id").select(
        "event_id", r6(scoring.w_eff(F.col("w_i"), F.col("asf")), "w_eff"))


@query("silence_check", with_ctes(f"""
    select event_id, bool_and(eff is null or eff<0.02) as is_silent from (
      select r.event_id, {_EFF} as eff from event_role r
      left join (select * from timeline where importance<>'D') t on t.role_id=r.role_id and t.event_id=r.event_id) group by event_id""",
    "event_role", "timeline", "clock"))
def silence_check(t):
    return tl.silence_check(t.event_role, t.timeline.filter("importance <> 'D'"), t.as_of)


@query("energy_trigger", "with recursive " + with_ctes("""
    select role_id, event_id, round(e,6) as energy, e>5 and e-arousal<=5 as triggers from walk""", "timeline",
    num="select role_id, event_id, create_time, arousal, row_number() over (partition by role_id order by create_time, event_id) as rn from timeline",
    walk="""select role_id, event_id, create_time, arousal, rn, arousal as e from num where rn=1
      union all select n.role_id, n.event_id, n.create_time, n.arousal, n.rn,
        n.arousal + w.e*exp(-0.1*(epoch_us(n.create_time)-epoch_us(w.create_time))/3600e6) from walk w join num n on n.role_id=w.role_id and n.rn=w.rn+1""")[5:])
def energy_trigger(t):
    return tl.accumulated_energy(t.timeline).select("role_id", "event_id", r6("energy", "energy"), "triggers")


@query("capacity_silence", with_ctes(f"""
    select role_id, event_id, place, place>floor(n*(0.6-0.2*0.0)) as silent_at_rest, place>floor(n*(0.6-(0.6-0.4)*0.5)) as silent_under_load from (
      select role_id, event_id, row_number() over (order by round(eff,9) desc, role_id, event_id) as place, count(*) over () as n from (select *, {_EFF} as eff from timeline))""",
    "timeline", "clock"))
def capacity_silence(t):
    timeline = t.timeline.withColumn("forgetting_factor", affect.base_forgetting(F.col("memory_weight"), power=libm.power))
    rest = tl.capacity_silence(timeline, t.as_of, F.lit(1.0)).select("role_id", "event_id", "place", F.col("is_silent").alias("silent_at_rest"))
    load = tl.capacity_silence(timeline, t.as_of, F.lit(2.5)).select("role_id", "event_id", F.col("is_silent").alias("silent_under_load"))
    return rest.join(load, ["role_id", "event_id"])


@query("habituation", with_ctes("""
    select role_id, event_id, round(arousal*pow(0.99::double, times) + 1e-9, 6) as arousal, round(valence*pow(0.99::double, times) + 1e-9, 6) as valence,
      round(100*pow(least(greatest(arousal,0),1),2)*(1+0.3*greatest(0,-valence)) + 1e-9,6) as base_factor
    from event_role join (select event_id, count(*) as times from (select event_id from hits union all select event_id from hits where route<2) group by event_id) using (event_id)""",
    "event_role", "hits"))
def habituation(t):
    recalled = t.hits.select("event_id").unionAll(t.hits.filter("route < 2").select("event_id")).groupBy("event_id").agg(F.count("*").alias("times"))
    base = affect.base_forgetting(affect.unit(F.col("arousal")), valence=F.col("valence"), alpha=0.3)
    return t.event_role.join(recalled, "event_id").select(
        "role_id", "event_id", r6(affect.habituated(F.col("arousal"), F.col("times")) + 1e-9, "arousal"),
        r6(affect.habituated(F.col("valence"), F.col("times")) + 1e-9, "valence"), r6(base + 1e-9, "base_factor"))


@query("ptsd_flag", with_ctes("select event_id, max(arousal)>0.8 as ptsd_immune from event_role group by event_id", "event_role"))
def ptsd_flag(t):
    return tl.immune_flag(t.event_role)


@query("fifo_penalty", with_ctes("""
    select role_id, event_id, c as chars_to_newest, c>1000 as is_penalised from (select role_id, event_id,
      sum(length(role_summary)) over (partition by role_id order by create_time desc, event_id desc
        rows unbounded preceding)::bigint as c from timeline)""", "timeline"))
def fifo_penalty(t):
    return tl.fifo_penalty(t.timeline, 1000).select("role_id", "event_id", "chars_to_newest", "is_penalised")


@query("timeline_digest", with_ctes(f"""
    select role_id, string_agg('['||strftime(create_time,'%Y-%m-%d %H:%M')||'] ('||importance||') '||role_summary, chr(10)
        order by create_time, event_id) as digest
    from (select *, row_number() over (partition by role_id order by score desc, create_time, event_id) as rn from (
      select *, case when sum(length(role_summary)) over (partition by role_id order by create_time desc, event_id desc
          rows unbounded preceding) > 1000 then memory_weight*0.4+{_RET}*0.6 else 1.0 end as score from timeline))
    where rn<=20 group by role_id""", "timeline", "clock"))
def timeline_digest(t):
    return tl.timeline_digest(t.timeline, t.as_of, capacity=1000)


def _rolling_sql(cond: str) -> str:
    return f"""
    select a.role_id, a.event_id, round((a.valence+coalesce(sum(h.valence*w),0))/(1+coalesce(sum(w),0)),6) as rolling_valence,
      round((a.arousal+coalesce(sum(h.arousal*w),0))/(1+coalesce(sum(w),0)),6) as rolling_arousal,
      round(a.arousal+coalesce(sum(h.arousal*w),0),6) as energy
    from n a left join (select a.event_id as aid, a.role_id as arole, h.valence, h.arousal,
        exp(-0.1*(epoch_us(a.create_time)-epoch_us(h.create_time))/3600e6) as w
      from n a join n h on a.role_id=h.role_id and h.rn<a.rn and {cond}) h on h.aid=a.event_id and h.arole=a.role_id
    group by a.role_id, a.event_id, a.valence, a.arousal"""


_NUMBERED = "select *, row_number() over (partition by role_id order by create_time, event_id) as rn from timeline"


@query("rolling_affect", with_ctes(_rolling_sql("h.rn<=10"), "timeline", n=_NUMBERED))
def rolling_affect(t):
    out = tl.rolling_affect(t.timeline)
    return out.select("role_id", "event_id", *[r6(c, c) for c in ("rolling_valence", "rolling_arousal", "energy")])


@query("rolling_affect_latest", with_ctes(_rolling_sql("h.rn>=a.rn-10"), "timeline", n=_NUMBERED))
def rolling_affect_latest(t):
    out = tl.rolling_affect(t.timeline, history="latest")
    return out.select("role_id", "event_id", *[r6(c, c) for c in ("rolling_valence", "rolling_arousal", "energy")])


@query("history_limit", with_ctes("select role_id, event_id, rn::int as rn from n where rn<=10", "timeline", n=_NUMBERED))
def history_limit(t):
    return tl.history_limit(t.timeline, 10).select("role_id", "event_id", "rn")


@query("forgetting_score", with_ctes(f"""
    select role_id, event_id, round(eff,6) as effective, round(ret,6) as retention, eff<0.02 as is_silenced,
      1.0::double as score_plain, round((memory_weight*0.4+ret*0.6)*eff,6) as score_penalised
    from (select *, {_EFF} as eff, {_RET} as ret from timeline)""", "timeline", "clock"))
def forgetting_score(t):
    out = tl.forgetting_scores(t.timeline, t.as_of)
    return out.select("role_id", "event_id", r6("effective", "effective"), r6("retention", "retention"), "is_silenced",
                      "score_plain", r6("score_penalised", "score_penalised"))


@query("base_forgetting", with_ctes("""
    select role_id, event_id, round(least(greatest(arousal,0),1),6) as memory_weight,
      round(100*pow(least(greatest(arousal,0),1),2),6) as base_factor from event_role""", "event_role"))
def base_forgetting(t):
    w = affect.unit(F.col("arousal"))
    return t.event_role.select("role_id", "event_id", r6(w, "memory_weight"), r6(affect.base_forgetting(w), "base_factor"))


@query("reinforce", with_ctes("""
    select role_id, event_id, round(case when value>=100 then least(greatest(forgetting_factor,1)*1.5,300) else forgetting_factor end,6) as forgetting_factor,
      epoch_us(case when value>=100 then (select t from clock) else last_accessed_time end) as accessed_us
    from timeline join (select event_id, value from event) using (event_id)""", "timeline", "clock"))
def reinforce(t):
    recalled = t.event.filter("value >= 100").select("event_id")
    return tl.reinforce(t.timeline, recalled, t.as_of).select(
        "role_id", "event_id", r6("forgetting_factor", "forgetting_factor"), us("last_accessed_time", "accessed_us"))


@query("emotion_synth", with_ctes("""
    select event_id, role_id, round(arousal,6) as arousal, round(valence,6) as valence from event_role""", "event_role"))
def emotion_synth(t):
    return t.event_role.select("event_id", "role_id", r6(affect.arousal(F.col), "arousal"), r6(affect.valence(F.col), "valence"))


@query("timeline_update", with_ctes("""
    select role_id, event_id, epoch_us(create_time) as at_us, importance, role_summary, round(memory_weight,6) as memory_weight,
      round(forgetting_factor,6) as forgetting_factor from timeline where n%4<>0""", "timeline"))
def timeline_update(t):
    src = t.event_role.withColumn("is_abstract", F.col("n") % 4 == 0)
    return tl.timeline_update(src).select("role_id", "event_id", us("create_time", "at_us"), "importance", "role_summary",
                                          r6("memory_weight", "memory_weight"), r6("forgetting_factor", "forgetting_factor"))


@query("snapshot_pick", with_ctes("""
    select event_id, role_id, case when importance in ('S','A') then coalesce(l3_decision,l2_interaction,l1_mention)
      else coalesce(l2_interaction,l1_mention,l3_decision) end as picked from event_role""", "event_role"))
def snapshot_pick(t):
    return t.event_role.select("event_id", "role_id", tl.snapshot_pick(tl.primary_role()).alias("picked"))


# -- role registry -----------------------------------------------------------
_EXTRACTED = """
  select c_custkey as n, case c_custkey%4 when 0 then 'ROL-U'||c_custkey when 1 then 'ROL-X'||c_custkey when 2 then 'null' end as given_id,
    case c_custkey%5 when 0 then 'NATION_'||(c_custkey%25) when 1 then c_name when 2 then 'KEY_'||(c_custkey%100)
      when 3 then 'Nobody '||(c_custkey%50) else c_custkey::varchar end as name from customer"""
_INDEX = """
  select key, arg_min(role_id, p||role_id) as role_id from (select name as key, 0 as p, role_id from role
    union all select unnest(aliases), 1, role_id from role) group by key"""


def extracted_roles(t):
    c = F.col("c_custkey")
    rid, nm = c % 4, c % 5
    return t.raw("customer").select(
        c.alias("n"),
        F.when(rid == 0, F.concat(F.lit("ROL-U"), c)).when(rid == 1, F.concat(F.lit("ROL-X"), c)).when(rid == 2, "null").alias("given_id"),
        F.when(nm == 0, F.concat(F.lit("NATION_"), c % 25)).when(nm == 1, F.col("c_name")).when(nm == 2, F.concat(F.lit("KEY_"), c % 100))
        .when(nm == 3, F.concat(F.lit("Nobody "), c % 50)).otherwise(c.cast("string")).alias("name"))


@query("role_resolve", with_ctes("""
    select e.n, coalesce(r.role_id, i.role_id, 'ROL-'||md5(e.name)) as role_id, coalesce(r.role_id, i.role_id) is null as is_new,
      case when coalesce(r.role_id, i.role_id) is null and regexp_matches(e.name,'^[0-9]+$')
        then '未知人物_'||right('ROL-'||md5(e.name),4) else e.name end as clean_name,
      coalesce(r.role_id, i.role_id) is null and regexp_matches(e.name,'^[0-9]+$') as is_suspicious
    from extracted e left join role r on r.role_id=e.given_id left join idx i on i.key=e.name""",
    "role", extracted=_EXTRACTED, idx=_INDEX))
def role_resolve(t):
    return roles.role_resolve(extracted_roles(t), t.role).select("n", "role_id", "is_new", "clean_name", "is_suspicious")


@query("role_pool_backfill", with_ctes("""
    select n.event_id, n.role_id, n.pos, coalesce(p.importance,'C') as importance, p.arousal is not null as from_pool
    from (select event_id, role_id, min(pos) as pos from (
        select e.event_id, x.pos, coalesce(i.role_id, x.name) as role_id from event e,
          lateral (values (1, ' Customer#'||lpad(user_id::varchar,9,'0')), (2, 'KEY_'||k), (3, 'Customer#'||lpad(user_id::varchar,9,'0')||' '),
                          (4, 'Stranger '||(n%7)), (5, '  ')) x(pos, raw),
          lateral (select trim(raw) as name) y left join idx i on i.key=y.name where y.name<>'') group by event_id, role_id) n
    left join event_role p using (event_id, role_id)""".replace("x.name", "y.name"), "event", "event_role", "role", idx=_INDEX))
def role_pool_backfill(t):
    cust = F.concat(F.lit("Customer#"), F.lpad(F.col("user_id").cast("string"), 9, "0"))
    item = lambda i, c: F.struct(F.lit(i).alias("pos"), c.alias("name"))
    names = t.event.select("event_id", F.explode(F.array(
        item(1, F.concat(F.lit(" "), cust)), item(2, F.concat(F.lit("KEY_"), "k")), item(3, F.concat(cust, F.lit(" "))),
        item(4, F.concat(F.lit("Stranger "), F.col("n") % 7)), item(5, F.lit("  ")))).alias("x")).select("event_id", "x.*")
    pool = t.event_role.select("event_id", "role_id", "importance", "arousal")
    return roles.role_pool_backfill(names, t.role, pool).select("event_id", "role_id", "pos", "importance", "from_pool")


_FOCUS_TEXT = """
  select 'D-'||doc_id as query_id, lower(text||' '||upper('customer#'||lpad((doc_id%200)::varchar,9,'0'))
    ||case when doc_id%3=0 then ' met nation_'||(doc_id%25) else '' end) as text from documents"""


def focus_texts(t):
    d = F.col("doc_id")
    return t.raw("documents").select(F.concat(F.lit("D-"), d).alias("query_id"), F.concat(
        "text", F.lit(" "), F.upper(F.concat(F.lit("customer#"), F.lpad((d % 200).cast("string"), 9, "0"))),
        F.when(d % 3 == 0, F.concat(F.lit(" met nation_"), d % 25)).otherwise("")).alias("text"))


_FOCUS = """
  select query_id, role_id from texts q join (select role_id, lower(name) as key from role
    union all select role_id, lower(unnest(aliases)) from role) r on contains(q.text, r.key)
  union select query_id, 'ROL-U0' from texts"""


@query("focus_roles", with_ctes("select * from focus", "role", texts=_FOCUS_TEXT, focus=_FOCUS))
def focus_roles(t):
    return roles.focus_roles(focus_texts(t), t.role, core_role="ROL-U0")


@query("entity_hint", with_ctes("""
    select query_id, string_agg(word, ' ' order by role_id, i) as hint from (
      select query_id, word, min(role_id) as role_id, arg_min(i, role_id) as i from (
        select query_id, role_id, unnest([name]||aliases) as word, unnest(range(1+len(aliases))) as i from focus join role using (role_id))
      group by query_id, word) group by query_id""", "role", texts=_FOCUS_TEXT, focus=_FOCUS))
def entity_hint(t):
    return roles.entity_hint(roles.focus_roles(focus_texts(t), t.role, core_role="ROL-U0"), t.role)


@query("role_report", with_ctes(f"""
    select n.key, i.role_id, r.entity_type, coalesce(d.entries,0)::int as entries, d.first_line
    from (select distinct name as key from extracted) n join idx i using (key) join role r using (role_id)
    left join (select role_id, count(*) as entries, arg_min('['||strftime(create_time,'%Y-%m-%d %H:%M')||'] ('||importance||') '||role_summary, (create_time, event_id)) as first_line
      from (select *, row_number() over (partition by role_id order by score desc, create_time, event_id) as rn from (
        select *, case when sum(length(role_summary)) over (partition by role_id order by create_time desc, event_id desc
          rows unbounded preceding) > 20000 then memory_weight*0.4+{_RET}*0.6 else 1.0 end as score from timeline))
      where rn<=20 group by role_id) d using (role_id)""", "role", "timeline", "clock", extracted=_EXTRACTED, idx=_INDEX))
def role_report(t):
    keys = extracted_roles(t).select(F.col("name").alias("key")).distinct()
    who = keys.join(roles.name_index(t.role), "key").join(t.role.select("role_id", "entity_type"), "role_id")
    lines = tl.timeline_digest(t.timeline, t.as_of).withColumn("l", F.split("digest", "\n"))
    return who.join(lines, "role_id", "left").select(
        "key", "role_id", "entity_type", F.coalesce(F.size("l"), F.lit(0)).alias("entries"), F.get("l", F.lit(0)).alias("first_line"))


# -- encodings over affect -----------------------------------------------------
@query("emo_project", with_ctes("""
    select event_id, round(v[1]/l,6) as e1, round(v[7]/l,6) as e7, round(v[32]/l,6) as e32 from (
      select event_id, v, coalesce(nullif(sqrt(list_sum(list_transform(v, lambda x: x*x))),0),1) as l from (
        select event_id, list_transform(range(1,33), lambda j: """ + "+".join(
            f"sin({i + 1}*j*0.17)*{c}" for i, c in enumerate(("valence", "arousal", "energy", *EMOTIONS))) + """) as v
        from (select event_id, avg(valence) as valence, max(arousal) as arousal, sum(arousal) as energy, """
    + ", ".join(f"max({e}) as {e}" for e in EMOTIONS) + " from event_role group by event_id)))", "event_role"))
def emo_project(t):
    f = tl.emo_features(t.event_role.withColumn("energy", F.col("arousal")))
    out = f.withColumn("v", vectors.emo_project([F.col(c) for c in ("valence", "arousal", "energy", *EMOTIONS)], 32))
    return out.select("event_id", *[r6(F.col("v")[i - 1], f"e{i}") for i in (1, 7, 32)])

"""Scans, sources, sinks, filters."""

from pyspark.sql import Window, functions as F

from memlake.config import DEFAULT as CFG
from memlake.functions import ids, text as tx, vectors
from memlake.mappings import scalar, with_ctes
from memlake.operators import timeline as tl
from memlake.registry.core import query, r6, us
from memlake.sources import buckets, corpus, lake, responses, versions
from memlake.streaming.jobs import scratch

_STRIP = r"regexp_replace({x}, '^\s+|\s+$', '', 'g')"
_STOPS = "。.!?！？”』〉\"'"


@query("corpus_trim", with_ctes(
    f"""select page_id, length(t)::int as chars, md5(t) as body_md5 from (
        select page_id, {_STRIP.format(x="replace(case when strpos(b,'</body>')>0 then left(b, strpos(b,'</body>')-1) else b end, chr(13)||chr(10), chr(10))")} as t
        from (select page_id, case when strpos(html,'<body>')>0 then substr(html, strpos(html,'<body>')+6) else html end as b
              from pages))"""))
def corpus_trim(t):
    body = t.raw("pages").select("page_id", tx.trim_markers(F.col("html"), "<body>", "</body>").alias("b"))
    return body.select("page_id", F.length("b").alias("chars"), F.md5("b").alias("body_md5"))


@query("corpus_chunk", """
    select doc_id, length(text)::bigint as chars, md5(text) as text_md5, true as sizes_ok, length(text) <= 2000 as whole,
      length(text) - length(regexp_replace(text, '[。.][”』〉"'']*', '', 'g')) = 0 as stopless from documents where text <> ''""")
def corpus_chunk(t):
    pieces = corpus.corpus_chunk(t.raw("documents"), stops="。.")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "content"))), lambda s: s["content"]), "")
    last = Window.partitionBy("doc_id").orderBy(F.col("id").desc())
    pieces = pieces.withColumn("is_last", F.row_number().over(last) == 1)
    ends = F.col("content").rlike(r"[。.][”』〉\"']*$")
    inner = F.col("content").rlike(r"[。.]")
    # a piece ends at a stop, unless no stop was near its aim; a piece without any is as long as an aim may be
    fair = (F.col("size") == F.length("content")) & (F.col("size") > 0) & (F.col("is_last") | ends | (F.col("size").between(300, 2000) & ~F.substr("content", F.lit(151)).rlike(r"[。.]")))
    return pieces.groupBy("doc_id").agg(
        F.sum("size").alias("chars"), F.md5(joined).alias("text_md5"), F.bool_and(fair).alias("sizes_ok"),
        ((F.count("*") == 1) & (F.sum("size") <= 2000)).alias("whole"), (F.count_if(inner) == 0).alias("stopless"))


@query("chunk_json_io", """
    select doc_id::int as id, length(text)::int as size, md5(text) as content_md5
    from documents where doc_id > 10 order by doc_id limit 500""")
def chunk_json_io(t):
    chunks = t.raw("documents").select(F.col("doc_id").cast("int").alias("id"), F.length("text").alias("size"),
                                       F.col("text").alias("content"))
    path = scratch(t.spark, "chunks")
    corpus.write_chunks(chunks, path)
    back = corpus.read_chunks(t.spark, path)
    return corpus.resume_chunks(back, 10, 500).select("id", "size", F.md5("content").alias("content_md5"))


@query("chunk_quality", """
    select count(*) as chunks,
      count(*) filter (where right(text,1) in ('。','！','？','”','』','〉','"','''')) as good_end,
      count(*) filter (where length(text) between 100 and 4000) as good_size, count(*) filter (where n_chars = length(text)) as true_size
    from documents""")
def chunk_quality(t):
    docs = t.raw("documents")
    return corpus.chunk_quality(docs.select(F.col("doc_id").alias("id"), F.col("n_chars").alias("size"), F.col("text").alias("content")))


@query("event_scan", with_ctes(
    "select event_id, epoch_us(create_time) as at_us from event where not is_abstract and not is_abstracted "
    "and status='active' and not is_tombstoned order by create_time, event_id", "event"))
def event_scan(t):
    out = lake.event_scan(t.event, is_abstract=False, is_abstracted=False, status="active")
    return out.orderBy("create_time", "event_id").select("event_id", us("create_time", "at_us"))


@query("event_lookup", with_ctes(
    "select event_id, value from event where event_id in "
    "(select 'EVT-'||lpad((o_orderkey*7)::varchar,12,'0') from orders)", "event"))
def event_lookup(t):
    wanted = t.raw("orders").select(
        F.concat(F.lit("EVT-"), F.lpad((F.col("o_orderkey") * 7).cast("string"), 12, "0")).alias("event_id"))
    return lake.event_lookup(t.event, wanted).select("event_id", "value")


_UPSERT = """
    with d as (select o_orderkey, o_orderstatus, o_totalprice, 0 as version from orders
      union all select o_orderkey + (select max(o_orderkey)+1 from orders)*(case when o_orderkey%10=0 then 1 else 0 end),
        'R', o_totalprice*2, 1 from orders where o_orderkey%5=0)
    select o_orderkey, o_orderstatus, round(o_totalprice,6) as o_totalprice from (
      select *, row_number() over (partition by o_orderkey order by version desc) as rn from d) where rn=1"""


@query("upsert_latest", _UPSERT)
def upsert_latest(t):
    base, delta = order_versions(t)
    return lake.upsert_latest(base, delta, ["o_orderkey"], "version").select(
        "o_orderkey", "o_orderstatus", r6("o_totalprice", "o_totalprice"))


@query("upsert_buckets", _UPSERT)
def upsert_buckets(t):
    base, delta = order_versions(t)
    layout = buckets.create(base, scratch(t.spark, "orders"), ["o_orderkey"], 16)
    buckets.upsert(layout, delta, "version", scratch(t.spark, "staged"))
    return layout.table().select("o_orderkey", "o_orderstatus", r6("o_totalprice", "o_totalprice"))


def order_versions(t):
    """Orders as a base table, and a delta that rewrites a tenth of them and adds as many."""
    base = t.raw("orders").select("o_orderkey", "o_orderstatus", "o_totalprice", F.lit(0).alias("version"))
    moved = F.when(F.col("o_orderkey") % 10 == 0, scalar(base, F.max("o_orderkey")) + 1).otherwise(0)
    delta = base.filter("o_orderkey % 5 = 0").select(
        (F.col("o_orderkey") + moved).alias("o_orderkey"), F.lit("R").alias("o_orderstatus"),
        (F.col("o_totalprice") * 2).alias("o_totalprice"), F.lit(1).alias("version"))
    return base, delta


_BLOCK = """
  select query_id, event_id, position from (
    select query_id, event_id, row_number() over (partition by query_id order by distance, event_id) as position from hits)
  where position <= 60"""


def hit_block(t):
    w = Window.partitionBy("query_id").orderBy("distance", "event_id")
    return t.hits.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= CFG.n_results)


@query("recall_log_append", with_ctes(
    "select query_id, array_to_string(list(event_id order by position), '|') as ids, count(*)::int as n from block group by query_id",
    "hits", block=_BLOCK))
def recall_log_append(t):
    block = hit_block(t)
    twice = block.unionByName(block.withColumn("position", F.col("position") + 100))
    path = scratch(t.spark, "recall-log")
    for part in (F.col("even"), ~F.col("even")):  # two runs append to one log
        lake.append_recall_log(lake.recall_log_rows(twice.withColumn("even", F.xxhash64("query_id") % 2 == 0).filter(part)), path)
    return t.spark.read.parquet(path).select(
        "query_id", F.array_join("event_ids", "|").alias("ids"), F.size("event_ids").alias("n"))


@query("schema_backfill", with_ctes(
    "select event_id, value, case when n%2=0 then 'normal' else 'dream' end as origin, "
    "case when n%2=0 then 0.0 else abstract_coverage end as abstract_coverage from event", "event"))
def schema_backfill(t):
    old = t.event.filter("n % 2 = 0").select("event_id", "value")
    new = t.event.filter("n % 2 = 1").select("event_id", "value", F.lit("dream").alias("origin"), "abstract_coverage")
    return lake.schema_backfill(new, old, {"origin": F.lit("normal"), "abstract_coverage": F.lit(0.0)})


_VECTOR_UPSERT = with_ctes(
    "select event_id, round(list_sum(list_transform(v, lambda x: x*x)),6) as len2, round(v[1],6) as v1, round(v[48],6) as v48, "
    "false as is_abstract, 'active' as status, 'ROL-U'||label as role_ids from (select *, "
    "list_transform(list_concat(embedding[1:40], list_transform(range(8), lambda x: 0.0::double)), "
    "lambda x: x/sqrt(list_sum(list_transform(embedding[1:40], lambda y: y*y)))) as v from vector)", "vector")


def vector_versions(t):
    """Stale vectors, and fresh ones for all of them."""
    fresh = t.vector.select("event_id", F.lit(1).alias("version"),
                            vectors.unit_project(F.slice("embedding", 1, 40), 48).alias("v"), F.lit(False).alias("is_abstract"),
                            F.lit("active").alias("status"), F.concat(F.lit("ROL-U"), "label").alias("role_ids"))
    return fresh.withColumns({"version": F.lit(0), "status": F.lit("silent")}), fresh


def vector_row(out):
    return out.select("event_id", r6(vectors.dot(F.col("v"), F.col("v")), "len2"), r6(F.col("v")[0], "v1"),
                      r6(F.col("v")[47], "v48"), "is_abstract", "status", "role_ids")


@query("vector_upsert", _VECTOR_UPSERT)
def vector_upsert(t):
    stale, fresh = vector_versions(t)
    return vector_row(lake.upsert_latest(stale, fresh, ["event_id"], "version"))


@query("vector_upsert_buckets", _VECTOR_UPSERT)
def vector_upsert_buckets(t):
    stale, fresh = vector_versions(t)
    layout = buckets.create(stale, scratch(t.spark, "vectors"), ["event_id"], 16)
    buckets.upsert(layout, fresh, "version", scratch(t.spark, "staged"))
    return vector_row(layout.table())


@query("vector_reindex_published", with_ctes("""
    select event_id, round(list_sum(list_transform(range(48), lambda i: v[i+1]*(i+1))),6) as rising, round(list_sum(list_transform(range(48), lambda i: v[i+1]*v[i+1]*(48-i))),6) as falling,
      round(list_max(v),6) as largest, round(list_min(v),6) as least from (select event_id,
        list_transform(list_concat(embedding[1:40], list_transform(range(8), lambda x: 0.0::double)), lambda x: x/sqrt(list_sum(list_transform(embedding[1:40], lambda y: y*y)))) as v
      from vector where vec_id%7<>0)""", "vector"))
def vector_reindex_published(t):
    """All vectors are written anew as a second version; what is read is what the pointer names. Every value counts in the sums."""
    path = scratch(t.spark, "vectors")
    versions.publish(t.vector.select("event_id", F.col("embedding").cast("array<double>").alias("v")), path)
    kept = versions.read(t.spark, path).filter(F.substring_index("event_id", "-", -1).cast("bigint") % 7 != 0)
    versions.publish(kept.select("event_id", vectors.unit_project(F.slice("v", 1, 40), 48).alias("v")), path)
    at = lambda weigh: F.aggregate(F.transform("v", weigh), F.lit(0.0), lambda a, x: a + x)
    return versions.read(t.spark, path).select("event_id", r6(at(lambda x, i: x * (i + 1)), "rising"), r6(at(lambda x, i: x * x * (48 - i)), "falling"),
                                               r6(F.array_max("v"), "largest"), r6(F.array_min("v"), "least"))


_RAW = r"""
  select conv_id, turn, regexp_replace(text, '[\s"\\{}]+', ' ', 'g') as s, (conv_id*7+turn)%8 as kind from conversations"""


def raw_answers(t):
    """Conversations wrapped as model answers with eight planted kinds of damage."""
    s = F.regexp_replace("text", r'[\s"\\{}]+', " ")
    kind = (F.col("conv_id") * 7 + F.col("turn")) % 8
    body = F.concat(F.lit('{"summary": "'), F.col("s"), F.lit('", "char_count": '), F.length("s").cast("string"), F.lit("}"))
    raw = (
        F.when(F.col("kind") == 1, F.concat(F.lit("Sure:\n```json\n"), body, F.lit("\n```\nDone.")))
        .when(F.col("kind") == 2, F.concat(F.substring(body, 1, 1000000000).substr(F.lit(1), F.length(body) - 1), F.lit(",}")))
        .when(F.col("kind") == 3, F.concat(F.lit('{"summary": "'), F.col("s"), F.lit('\n", "char_count": 7}')))
        .when(F.col("kind") == 4, F.concat(F.lit("Here it is "), body, F.lit(" hope it helps")))
        .when(F.col("kind") == 5, F.concat(F.lit('{"summary": "say "hi" '), F.col("s"), F.lit('", "char_count": 3}')))
        .when(F.col("kind") == 6, F.col("s")).when(F.col("kind") == 7, F.lit("  ")).otherwise(body))
    return t.raw("conversations").select("conv_id", "turn", s.alias("s"), kind.alias("kind")).withColumn("raw", raw).withColumn(
        "task_type", F.when(F.col("kind") % 2 == 0, "summary").otherwise("segmentation"))


@query("response_parse", with_ctes("""
    select conv_id, turn, case kind when 3 then 'controls' when 4 then 'braces' when 5 then 'salvaged'
        when 6 then 'rejected' when 7 then 'rejected' else 'clean' end as stage,
      case when kind=3 then s||' ' when kind=5 then 'say "hi" '||s when kind<6 then s end as summary,
      (case when kind=3 then 7 when kind<5 then length(s) end)::int as char_count from raw_rows""", raw_rows=_RAW))
def response_parse(t):
    out = responses.response_parse(raw_answers(t), "raw", "summary string, char_count int")
    return out.select("conv_id", "turn", "stage", "parsed.summary", "parsed.char_count")


@query("response_reject", with_ctes("""
    select conv_id, turn, case when kind=6 then 'summary' else 'segmentation' end as task_type,
      case when kind=7 or trim(s)='' then 'empty' else 'no_json' end as reason,
      (case when kind=6 then length(s) else 2 end)::int as raw_chars from raw_rows where kind>=6""", raw_rows=_RAW))
def response_reject(t):
    out = responses.response_parse(raw_answers(t), "raw", "summary string, char_count int")
    path = scratch(t.spark, "rejects")
    responses.write_rejects(responses.response_reject(out, "raw"), path)
    return t.spark.read.parquet(path).select(
        "conv_id", "turn", "task_type", "reason", F.length("raw").alias("raw_chars"))


@query("event_out", with_ctes("""
    select e.event_id, epoch_us(e.create_time) as at_us, md5(content_raw) as content_md5, length(s1)::int as l1_chars,
      e.is_abstract, e.is_abstracted, e.status, 0 as abstraction_level,
      round(a*0.9999::double,4) as activation_energy, round(a*0.9999::double,4) as affective_energy
    from event_text e join (select event_id, least(max(arousal),1.0) as a from event_role group by event_id) r using (event_id)""",
    "event_text", "event_role"))
def event_out(t):
    full = t.with_text(t.event.join(tl.event_affect(t.event, t.event_role), "event_id")).withColumn(
        "affective_energy", F.col("affective_energy") * 0.9999).withColumn(
        "activation_energy", F.col("affective_energy")).withColumn("abstraction_level", F.lit(0))
    return lake.event_out(full).select(
        "event_id", us("create_time", "at_us"), F.md5("content_raw").alias("content_md5"),
        F.length(F.col("summaries")["L1"]).alias("l1_chars"), "is_abstract", "is_abstracted", "status",
        "abstraction_level", "activation_energy", "affective_energy")


@query("event_preview", with_ctes("""
    select e.event_id, left(s1,60) as summary_l1, length(content_raw)::int as chars, is_abstract, roles
    from event_text e join (select event_id, string_agg(role_id, ',' order by pos) as roles from event_role group by event_id) r
    using (event_id)""", "event_text", "event_role"))
def event_preview(t):
    return lake.event_preview(t.event_text, t.event_role).withColumn("roles", F.array_join("roles", ","))


@query("role_nested", with_ctes("""
    select role_id, name, ((rn-1)//20)::int as block_no, count(event_id)::int as entries,
      string_agg(event_id||':'||importance, '|' order by create_time, event_id) as line
    from (select r.role_id, r.name, t.event_id, t.importance, t.create_time,
        row_number() over (partition by r.role_id order by t.create_time, t.event_id) as rn
      from role r left join timeline t using (role_id)) group by all""", "role", "timeline"))
def role_nested(t):
    out = lake.role_nested(t.role, t.timeline, 20)
    item = lambda s: F.concat_ws(":", s["event_id"], s["importance"])
    return out.select("role_id", "name", "block_no", F.coalesce(F.size("timeline"), F.lit(0)).alias("entries"),
                      F.array_join(F.transform("timeline", item), "|").alias("line"))


@query("role_flatten", with_ctes("""
    select r.role_id, r.name, t.event_id, t.importance, epoch_us(t.create_time) as at_us from role r left join timeline t using (role_id)""", "role", "timeline"))
def role_flatten(t):
    return lake.role_flatten(lake.role_nested(t.role, t.timeline, 20)).select("role_id", "name", "event_id", "importance", us("create_time", "at_us"))


# -- filters ---------------------------------------------------------------
@query("visible_events", with_ctes(
    "select event_id, status from event where not is_tombstoned and status<>'silent'", "event"))
def visible_events(t):
    return lake.visible_events(t.event).select("event_id", "status")


@query("event_count", with_ctes(
    "select is_abstract, is_tombstoned, count(*) as n from event group by all", "event"))
def event_count(t):
    return lake.event_count(t.event)


@query("timeline_filter", with_ctes("""
    select role_id, event_id, rn::int as rn from (select *, row_number() over (partition by role_id order by create_time, event_id) as rn
      from timeline where memory_weight >= 0.2) where rn<=30""", "timeline"))
def timeline_filter(t):
    return tl.timeline_filter(t.timeline, 0.2, 30).select("role_id", "event_id", "rn")


_NAMES = """select c_custkey, case c_custkey%8 when 0 then c_custkey::varchar when 1 then '  ' when 2 then 'Unknown'
    when 3 then 'NULL' else c_name end as name from customer"""


@query("suspicious_role", with_ctes("""
    select c_custkey, case when bad then '未知人物_'||right('ROL-'||md5(name||'|'||c_custkey),4) else name end as name, bad as is_suspicious
    from (select *, regexp_matches(name,'^[0-9]+$') or trim(name)='' or lower(name) in ('null','none','unknown','核心用户','未知角色') as bad from names)""",
    names=_NAMES))
def suspicious_role(t):
    k = F.col("c_custkey") % 8
    raw = t.raw("customer").withColumn(
        "name", F.when(k == 0, F.col("c_custkey").cast("string")).when(k == 1, "  ").when(k == 2, "Unknown")
        .when(k == 3, "NULL").otherwise(F.col("c_name")))
    rid = ids.content_id("ROL-", F.col("name"), F.col("c_custkey").cast("string"))
    return raw.select("c_custkey", tx.clean_name(F.col("name"), rid).alias("name"), tx.bad_name(F.col("name")).alias("is_suspicious"))


@query("primary_role", with_ctes(
    "select event_id, role_id, importance, importance in ('S','A') or role_id='ROL-U1' as is_primary from event_role", "event_role"))
def primary_role(t):
    return t.event_role.select("event_id", "role_id", "importance", tl.primary_role("ROL-U1").alias("is_primary"))


@query("stale_unclosed", with_ctes(
    "select conv_id, epoch_us(max(ts)) as last_us from turns group by conv_id "
    "having max(ts) >= (select max(ts) from turns) - interval 24 hour", "turns"))
def stale_unclosed(t):
    from memlake.operators.segment import drop_stale
    unclosed = t.turn.groupBy("conv_id").agg(F.max("ts").alias("last_hit_time"))
    return drop_stale(unclosed, scalar(t.turn, F.max("ts"))).select("conv_id", us("last_hit_time", "last_us"))


@query("oversized_flag", "select doc_id, length(text)::int as chars, length(text)>2400 as oversized from documents")
def oversized_flag(t):
    from memlake.operators.segment import oversized
    return t.raw("documents").select("doc_id", F.length("text").alias("chars"), oversized(F.col("text")).alias("oversized"))


@query("length_cap", "select doc_id, md5(left(text,2000)) as capped_md5, least(length(text),2000)::int as chars from documents")
def length_cap(t):
    capped = F.substring("text", 1, CFG.len_msg)
    return t.raw("documents").select("doc_id", F.md5(capped).alias("capped_md5"), F.length(capped).alias("chars"))


@query("distance_cap_filter", with_ctes("""
    select query_id, event_id, round(distance,6) as distance from hits h
    join (select 'Q-'||user_id as query_id, 0.2+(user_id%10)/20.0 as cap from event group by user_id) c using (query_id)
    where distance <= cap+1e-9""", "hits"))
def distance_cap_filter(t):
    from memlake.operators.recall import within_cap
    caps = t.event.select("user_id").distinct().select(
        F.concat(F.lit("Q-"), "user_id").alias("query_id"), (0.2 + F.col("user_id") % 10 / 20.0).alias("cap"))
    return within_cap(t.hits, caps).select("query_id", "event_id", r6("distance", "distance"))


@query("request_overrides", """
    select conv_id, turn, coalesce(case when turn%3=0 then 'single' end, 'multi') as user_mode,
      coalesce(case when turn%3=0 and conv_id%2=0 then 'ROL-U'||conv_id end, 'ROL-U0') as core_role,
      coalesce(case when role='system' then 'passive_log' end, 'dialogue') as mode from conversations""")
def request_overrides(t):
    from memlake.operators.output import with_overrides
    c, n = F.col("conv_id"), F.col("turn")
    req = t.raw("conversations").select(
        "conv_id", "turn", F.when(n % 3 == 0, "single").alias("user_mode"),
        F.when((n % 3 == 0) & (c % 2 == 0), F.concat(F.lit("ROL-U"), c)).alias("core_role"),
        F.when(F.col("role") == "system", "passive_log").alias("mode"))
    return with_overrides(req, {"user_mode": "multi", "core_role": "ROL-U0", "mode": "dialogue"})


@query("audit_schedule", with_ctes("""
    select event_id, user_id, rn as seq from (select event_id, user_id,
      row_number() over (partition by user_id order by create_time, event_id) as rn from event) where rn%10=0""", "event"))
def audit_schedule(t):
    from memlake.operators.monitor import audit_schedule as op
    return op(t.event, "user_id").select("event_id", "user_id", "seq")


@query("mode_output", with_ctes("""
    select turn_id, mode, case when mode<>'passive_log' then md5(text) end as context_md5,
      case when mode='npc_agent' then conv_id%3 else 0 end::int as directives
    from (select *, case turn%3 when 0 then 'dialogue' when 1 then 'passive_log' else 'npc_agent' end as mode from turns)""", "turns"))
def mode_output(t):
    from memlake.operators.output import mode_output as op
    k = F.col("turn") % 3
    rows = t.turn.select(
        "turn_id", F.when(k == 0, "dialogue").when(k == 1, "passive_log").otherwise("npc_agent").alias("mode"),
        F.md5("text").alias("context"), F.array_repeat(F.lit("idle"), (F.col("conv_id") % 3).cast("int")).alias("npc_directives"))
    return op(rows).select("turn_id", "mode", F.col("context").alias("context_md5"), F.size("npc_directives").alias("directives"))

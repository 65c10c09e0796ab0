"""Vectors, search, sampling, scoring."""

import math

from pyspark.sql import Window, functions as F

from memlake.config import DEFAULT as CFG, ENTITY_TERMS, EMOTION_TERMS, FACT_TERMS, ENTITY_PATTERN, EMOTION_PATTERN
from memlake.functions import affect, ids, scoring, text as tx, vectors
from memlake.mappings import AGE_DAYS, scalar, with_ctes
from memlake.operators import cells, recall, roles, sampling, search, timeline as tl
from memlake.operators.ordered import exact_percentiles
from memlake.operators.output import context_text
from memlake.registry.core import query, r6, us
from memlake.registry.sources import hit_block
from memlake.registry.timeline import _ASOF, _WEIGHT, _ABSTRACT_WEIGHT, user_abstracts
from memlake.sources import lake
from memlake.streaming.jobs import scratch

_FACTOR = "(1+0.5*log10(1+greatest(weight,0)))"
_MOOD = "(case when event_valence*query_valence>0 then 1+0.2*event_valence*query_valence else 1 end)"
_COVER = "(case when abstract_coverage>0 then exp(-2*abstract_coverage) else 1 end)"


@query("cosine", with_ctes("""
    select event_id, label, round(list_cosine_similarity(v.embedding, q.embedding),6) as cos
    from vector v join vector_query q using (label)""", "vector", "vector_query"))
def cosine(t):
    q = t.vector_query.select("label", F.col("embedding").alias("q"))
    return t.vector.join(q, "label").select("event_id", "label", r6(vectors.cosine(F.col("embedding"), F.col("q")), "cos"))


_PROJ = "select event_id, list_transform(u, lambda x: x/sqrt(list_sum(list_transform(u, lambda y: y*y)))) as v from (select event_id, {u} as u from vector)"


@query("unit_project", with_ctes(
    "select a.event_id, round(a.v[1],6) as cut1, round(a.v[40],6) as cut40, round(b.v[64],6) as pad64, round(b.v[80],6) as pad80 "
    "from cut a join pad b using (event_id)", "vector", cut=_PROJ.format(u="embedding[1:40]"),
    pad=_PROJ.format(u="list_concat(embedding, list_transform(range(16), lambda x: 0.0::double))")))
def unit_project(t):
    out = t.vector.select("event_id", vectors.unit_project(F.col("embedding"), 40).alias("a"), vectors.unit_project(F.col("embedding"), 80).alias("b"))
    return out.select("event_id", r6(F.col("a")[0], "cut1"), r6(F.col("a")[39], "cut40"), r6(F.col("b")[63], "pad64"), r6(F.col("b")[79], "pad80"))


_HEX = """list_transform(range(64), lambda i: ((strpos('0123456789abcdef', substr(h, (2*i+1)::bigint, 1))-1)*16
    + strpos('0123456789abcdef', substr(h, (2*i+2)::bigint, 1))-1)/255.0::double*2-1)"""


@query("hash_embed", with_ctes("""
    select doc_id, round(v[1]/l,6) as v1, round(v[33]/l,6) as v33, round(v[64]/l,6) as v64 from (
      select doc_id, v, sqrt(list_sum(list_transform(v, lambda x: x*x))) as l from raw)""",
    raw=f"""select doc_id, {_HEX} as v from (select doc_id, sha256(unhex(s||'00000000'))||sha256(unhex(s||'01000000')) as h
      from (select doc_id, sha256(text) as s from documents))"""))
def hash_embed(t):
    out = t.raw("documents").select("doc_id", vectors.hash_embed(F.col("text"), 64).alias("v"))
    return out.select("doc_id", *[r6(F.col("v")[i - 1], f"v{i}") for i in (1, 33, 64)])


@query("stable_uuid", with_ctes("""
    select event_id, substr(h,1,8)||'-'||substr(h,9,4)||'-5'||substr(h,14,3)||'-'||
      substr('89ab', (strpos('0123456789abcdef', substr(h,17,1))-1)%4+1, 1)||substr(h,18,3)||'-'||substr(h,21,12) as point_id,
      'EVT-'||md5(event_id||'|'||event_type) as content_id
    from (select event_id, event_type, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8')||event_id::blob) as h from event)""", "event"))
def stable_uuid(t):
    return t.event.select("event_id", ids.uuid5(F.col("event_id")).alias("point_id"),
                          ids.content_id("EVT-", F.col("event_id"), F.col("event_type")).alias("content_id"))


def encode_events(event, event_role, role, dim, texts=None, keep=()):
    """Tri-band vectors of event rows with the hash text model, and the columns `keep`.

    With `texts`, a function that adds raw text and summaries to rows, events come without them and texts join last.
    """
    words = roles.entity_text(event, event_role, role)
    feats = tl.emo_features(event_role.withColumn("energy", F.col("arousal")))
    names = ["valence", "arousal", "energy", "anger", "fear", "joy", "sadness", "surprise", "disgust", "trust", "anticipation"]
    rows = event.join(words, "event_id").join(feats, "event_id", "left").na.fill(0.0, names)
    return (texts(rows) if texts else rows).select(
        "event_id", *keep, vectors.hash_embed(tx.act_text(F.col("summaries"), F.col("content_raw")), dim).alias("act"),
        vectors.emo_project([F.col(n) for n in names], dim).alias("emo"), vectors.hash_embed(F.col("entity_text"), dim).alias("ent"))


_EMO_NAMES = ("valence", "arousal", "energy", "anger", "fear", "joy", "sadness", "surprise", "disgust", "trust", "anticipation")
_UNIT = "sqrt(list_sum(list_transform({v}, lambda x: x*x)))"


@query("event_encode", with_ctes(f"""
    select event_id, round(a[1]/{_UNIT.format(v='a')},6) as act1, round(e[2]/coalesce(nullif({_UNIT.format(v='e')},0),1),6) as emo2,
      round(n[64]/{_UNIT.format(v='n')},6) as ent64 from (
      select x.event_id, {_HEX.replace('(h,', '(ah,')} as a, {_HEX.replace('(h,', '(nh,')} as n,
        list_transform(range(1,65), lambda j: {"+".join(f"sin({i + 1}*j*0.17)*{c}" for i, c in enumerate(_EMO_NAMES))}) as e
      from (select event_id, sha256(unhex(sha256(left(s2,4000))||'00000000'))||sha256(unhex(sha256(left(s2,4000))||'01000000')) as ah from event_text) x
      join (select event_id, sha256(unhex(sha256(w)||'00000000'))||sha256(unhex(sha256(w)||'01000000')) as nh from (
        select event_id, string_agg(words, ' ' order by pos) as w from words group by event_id)) y using (event_id)
      join (select event_id, avg(valence) as valence, max(arousal) as arousal, sum(arousal) as energy,
        {", ".join(f"max({e}) as {e}" for e in _EMO_NAMES[3:])} from event_role group by event_id) z using (event_id))""",
    "event_text", "event_role", "role",
    words="select event_id, pos, r.role_id||coalesce(' '||array_to_string([name]||aliases,' '),'') as words from event_role r left join role using (role_id)"))
def event_encode(t):
    out = encode_events(t.event.select("event_id", "n"), t.event_role, t.role, 64, texts=t.with_text)
    return out.select("event_id", r6(F.col("act")[0], "act1"), r6(F.col("emo")[1], "emo2"), r6(F.col("ent")[63], "ent64"))


_TEXT_HASH = "sha256(unhex(sha256({x})||'00000000'))||sha256(unhex(sha256({x})||'01000000'))"


_ASKED = r"""select *, regexp_replace(right(shadow,1200)||chr(10)||text, '^\s+|\s+$', '', 'g') as ctx from (
      select turn_id, text, (turn%5)/5::double-0.5::double as va, case when turn%3=0 then 'before '||conv_id else '' end as shadow,
        case when turn%2=0 then 'Customer#'||conv_id else '' end as hint from turns)"""


@query("query_encode", with_ctes(f"""
    select turn_id, route, round(a[1]/{_UNIT.format(v='a')},6) as act1, round(q[3]/{_UNIT.format(v='q')},6) as emo3, round(n[1]/{_UNIT.format(v='n')},6) as ent1 from (
      select turn_id, route, {_HEX.replace('(h,', '(ah,')} as a, {_HEX.replace('(h,', '(nh,')} as n,
        list_transform(range(64), lambda j: sin((j+1)*0.11)*va+cos((j+1)*0.13)*0.3::double) as q
      from (select turn_id, route, {_TEXT_HASH.format(x='search')} as ah, {_TEXT_HASH.format(x='entity')} as nh, va from routes))""", "turns",
    **{"asked": _ASKED, "routes": r"""select turn_id, 0 as route, text as search, text as entity, va from asked
      union all select turn_id, 1, ctx, ctx, va from asked where shadow<>'' and ctx<>text union all select turn_id, 2, text, hint, va from asked where hint<>''"""}))
def query_encode(t):
    from memlake.plans.recall_job import encode_routes
    n = F.col("turn")
    asked = t.turn.select(
        F.col("turn_id").alias("query_id"), "text", (n % 5 / 5.0 - 0.5).alias("query_valence"),
        F.when(n % 3 == 0, F.concat(F.lit("before "), "conv_id")).otherwise("").alias("shadow"),
        F.when(n % 2 == 0, F.concat(F.lit("Customer#"), "conv_id")).otherwise("").alias("hint"))
    return encode_routes(asked, 64).select(
        F.col("query_id").alias("turn_id"), "route", r6(F.col("act")[0], "act1"), r6(F.col("emo")[2], "emo3"), r6(F.col("ent")[0], "ent1"))


def topk_sql(band: str, n: int, pool: str = "") -> str:
    return f"""select query_id, event_id, rank, score from (
      select query_id, event_id, list_cosine_similarity(q.{band}, v.{band}) as score,
        row_number() over (partition by query_id order by list_cosine_similarity(q.{band}, v.{band}) desc, event_id)::int as rank
      from vector_query q, vector v {pool}) where rank<={n}"""


@query("vector_topk", with_ctes("select query_id, event_id, rank, round(score,6) as score from top",
                                "vector", "vector_query", top=topk_sql("embedding", 60)))
def vector_topk(t):
    return search.vector_topk(t.vector_query, t.vector, 60).select("query_id", "event_id", "rank", r6("score", "score"))


_FUSED = """select query_id, event_id, sum(1.0::double/(60+rank)) as score from
  (select * from ta union all select * from te union all select * from tn) group by query_id, event_id"""


@query("band_fusion", with_ctes("""
    select query_id, event_id, rank, round(score,6) as score, round(1-score,6) as distance from (
      select *, row_number() over (partition by query_id order by round(score,12) desc, event_id)::int as rank from fused) where rank<=60""",
    "vector", "vector_query", ta=topk_sql("act", 60), te=topk_sql("emo", 60), tn=topk_sql("ent", 60), fused=_FUSED))
def band_fusion(t):
    out = search.band_fusion(t.vector_query, t.vector, {"act": 0.7, "emo": 0.1, "ent": 0.2}, 60)
    return out.select("query_id", "event_id", "rank", r6("score", "score"), r6("distance", "distance"))


def cell_index(t, *bands):
    """An index of the given vectors, written below the shared folder."""
    return cells.build(t.vector, scratch(t.spark, "cells"), bands)


@query("vector_topk_cells", with_ctes("select query_id, event_id, rank, round(score,6) as score from top",
                                      "vector", "vector_query", top=topk_sql("embedding", 60)))
def vector_topk_cells(t):
    return search.vector_topk(t.vector_query, cell_index(t, "embedding"), 60).select("query_id", "event_id", "rank", r6("score", "score"))


@query("band_fusion_cells", with_ctes("""
    select query_id, event_id, rank, round(score,6) as score, round(1-score,6) as distance from (
      select *, row_number() over (partition by query_id order by round(score,12) desc, event_id)::int as rank from fused) where rank<=60""",
    "vector", "vector_query", ta=topk_sql("act", 60), te=topk_sql("emo", 60), tn=topk_sql("ent", 60), fused=_FUSED))
def band_fusion_cells(t):
    out = search.band_fusion(t.vector_query, cell_index(t, "act", "emo", "ent"), {"act": 0.7, "emo": 0.1, "ent": 0.2}, 60)
    return out.select("query_id", "event_id", "rank", r6("score", "score"), r6("distance", "distance"))


@query("vector_neighbours_cells", with_ctes("""
    select query_id, event_id, rank, round(score,6) as score from (
      select q.event_id as query_id, v.event_id, list_cosine_similarity(q.embedding, v.embedding) as score,
        row_number() over (partition by q.event_id order by round(list_cosine_similarity(q.embedding, v.embedding),12) desc, v.event_id)::int as rank
      from (select * from vector where vec_id%100=0) q, vector v where v.label <> 1) where rank<=5""", "vector"))
def vector_neighbours_cells(t):
    asked = t.vector.filter("vec_id % 100 = 0").select(F.col("event_id").alias("query_id"), "embedding")
    index = cell_index(t, "embedding").restricted(t.vector.filter("label <> 1").select("event_id"))
    return search.vector_topk(asked, index, 5).select("query_id", "event_id", "rank", r6("score", "score"))


@query("union_hits", with_ctes("""
    select query_id, event_id, round(distance,6) as distance, route from (
      select *, row_number() over (partition by query_id, event_id order by distance, route) as rn from three) where rn=1""",
    "hits", three="""select query_id, event_id, distance, route from hits union all select query_id, event_id, distance*0.5, route+3 from hits where route=1
      union all select query_id, event_id, distance, route+6 from hits where route=2"""))
def union_hits(t):
    h = t.hits.select("query_id", "event_id", "distance", "route")
    more = h.filter("route = 1").withColumns({"distance": F.col("distance") * 0.5, "route": F.col("route") + 3})
    same = h.filter("route = 2").withColumn("route", F.col("route") + 6)
    return search.union_hits(h.unionByName(more).unionByName(same)).select("query_id", "event_id", r6("distance", "distance"), "route")


@query("multi_route_recall", with_ctes("""
    select 'C-'||conv_id||'-'||turn as query_id, route, md5(search_text) as search_md5, md5(entity_text) as entity_md5 from (
      select conv_id, turn, 0 as route, text as search_text, text as entity_text from q
      union all select conv_id, turn, 1, ctx, ctx from q where shadow<>'' and ctx<>text
      union all select conv_id, turn, 2, text, hint from q where hint<>'')""",
    q=r"""select *, regexp_replace(right(shadow,1200)||chr(10)||text, '^\s+|\s+$', '', 'g') as ctx from (
      select conv_id, turn, text, coalesce(lag(text) over (partition by conv_id order by turn),'') as shadow,
        case when turn%2=0 then 'Customer#'||conv_id else '' end as hint from conversations)"""))
def multi_route_recall(t):
    w = Window.partitionBy("conv_id").orderBy("turn")
    q = t.raw("conversations").select(
        F.concat_ws("-", F.lit("C"), "conv_id", "turn").alias("query_id"), "text", F.coalesce(F.lag("text").over(w), F.lit("")).alias("shadow"),
        F.when(F.col("turn") % 2 == 0, F.concat(F.lit("Customer#"), "conv_id")).otherwise("").alias("hint"))
    return search.route_texts(q).select("query_id", "route", F.md5("search_text").alias("search_md5"), F.md5("entity_text").alias("entity_md5"))


@query("hit_hydrate", with_ctes("""
    select query_id, event_id, round(h.distance,6) as distance, e.status, epoch_us(e.create_time) as at_us
    from hits h join event e using (event_id) where not e.is_tombstoned and e.status<>'silent'""", "hits"))
def hit_hydrate(t):
    out = search.hit_hydrate(t.hits.select("query_id", "event_id", "distance"), t.event)
    return out.select("query_id", "event_id", r6("distance", "distance"), "status", us("create_time", "at_us"))


_U = "(('0x'||left(md5(event_id),8))::bigint+0.5::double)/4294967296::double"
_KEYS = f"""select event_id, w_i, asf, u, greatest(w_i*(1-least(greatest(asf,0),0.999999)),1e-6) as w_eff,
    pow(u, 1/greatest(w_i*(1-least(greatest(asf,0),0.999999)),1e-6)) as sample_key
  from (select event_id, value as w_i, (n%90)/100::double as asf, {_U} as u from event)"""


def tier1(t):
    w = t.event.select("event_id", F.col("value").alias("w_i"))
    asf = t.event.select("event_id", ((F.col("n") % 90) / 100).alias("asf"))
    return sampling.tier1_rows(w, asf)


@query("sample_key", with_ctes("select event_id, round(u,6) as sample_u, round(w_eff,6) as w_eff, round(sample_key,6) as sample_key from keys",
                               "event", keys=_KEYS))
def sample_key(t):
    return tier1(t).select("event_id", r6("sample_u", "sample_u"), r6("w_eff", "w_eff"), r6("sample_key", "sample_key"))


@query("active_pool", with_ctes("select event_id, round(sample_key,6) as sample_key from keys order by keys.sample_key desc, event_id limit 3000",
                                "event", keys=_KEYS))
def active_pool(t):
    return sampling.active_pool(tier1(t), 3000).select("event_id", r6("sample_key", "sample_key"))


@query("active_pool_semi", with_ctes("""
    select query_id, event_id, round(distance,6) as distance from hits where event_id in
      (select event_id from keys order by sample_key desc, event_id limit 3000)""", "hits", keys=_KEYS))
def active_pool_semi(t):
    out = search.active_pool_semi(t.hits, sampling.active_pool(tier1(t), 3000))
    return out.select("query_id", "event_id", r6("distance", "distance"))


@query("tier1_refresh", with_ctes(f"""
    select event_id, round(w_i,6) as w_i, round(greatest(w_i,1e-6),6) as w_eff, round(u,6) as sample_u,
      round(pow(u, 1/greatest(w_i,1e-6)),6) as sample_key
    from (select event_id, w_i, {_U} as u from (select event_id, w_i from weight join event using (event_id) where not is_tombstoned and status<>'silent'
      union all select event_id, w_i from raised))""",
    "event", "event_role", "timeline", "clock", weight=_WEIGHT, raised=_ABSTRACT_WEIGHT))
def tier1_refresh(t):
    leaves = user_abstracts(t)
    roots = leaves.select(F.col("root").alias("event_id")).distinct().withColumns({
        "is_abstract": F.lit(True), "is_tombstoned": F.lit(False), "status": F.lit("active")})
    out = sampling.tier1_refresh(t.event.unionByName(roots, allowMissingColumns=True), t.event_role, t.timeline, t.as_of, leaves=leaves)
    return out.select("event_id", *[r6(c, c) for c in ("w_i", "w_eff", "sample_u", "sample_key")])


@query("recent_k", with_ctes(
    "select recall_id, epoch_us(created_at) as at_us, len(event_ids)::int as n from recall_log order by created_at desc, recall_id desc limit 200",
    "recall_log"))
def recent_k(t):
    return lake.newest(t.recall_log, 200, ["created_at", "recall_id"]).select("recall_id", us("created_at", "at_us"), F.size("event_ids").alias("n"))


@query("dream_sample", with_ctes(
    "select event_id, 'dream' as origin, md5('night-1|'||event_id) as draw from event order by draw, event_id limit 5", "event"))
def dream_sample(t):
    return sampling.dream_sample(t.event, "night-1", CFG.dream_batch).select("event_id", F.lit("dream").alias("origin"), "draw")


@query("time_boundary", with_ctes("""
    select epoch_us(create_time) as boundary_us from (select create_time, row_number() over (order by create_time)-1 as i, count(*) over () as n
      from event where not is_abstract and not is_tombstoned) where n>1000 and i=floor(n*(1-0.7::double))""", "event"))
def time_boundary(t):
    return search.time_boundary(t.event, CFG.recall_capacity).select(us("boundary", "boundary_us"))


@query("capacity_tier_join", with_ctes("""
    select query_id, event_id, round(distance,6) as distance, rn::int as place from (
      select *, row_number() over (partition by query_id order by distance, event_id) as rn from (
        select query_id, event_id, distance from (select *, row_number() over (partition by query_id order by distance, event_id) as r
          from hits where coalesce(create_time >= (select b from bound), true)) where r<=60
        union all
        select query_id, event_id, distance from (select *, row_number() over (partition by query_id order by distance, event_id) as r
          from hits h where create_time < (select b from bound) and exists (
            select 1 from focus f join event_role e using (role_id) where f.query_id=h.query_id and e.event_id=h.event_id)) where r<=40))
    where rn<=60""", "hits", "event_role",
    bound="""select create_time as b from (select create_time, row_number() over (order by create_time)-1 as i, count(*) over () as n
      from event where not is_abstract and not is_tombstoned) where n>1000 and i=floor(n*(1-0.7::double))""",
    focus="select distinct 'Q-'||user_id as query_id, 'ROL-K'||(user_id%100) as role_id from event"))
def capacity_tier_join(t):
    focus = t.event.select("user_id").distinct().select(
        F.concat(F.lit("Q-"), "user_id").alias("query_id"), F.concat(F.lit("ROL-K"), F.col("user_id") % 100).alias("role_id"))
    bound = search.time_boundary(t.event, CFG.recall_capacity).scalar()
    out = search.capacity_tiers(t.hits, bound, t.event_role, focus)
    return out.select("query_id", "event_id", r6("distance", "distance"), F.col("rn").alias("place"))


@query("bypass_search", with_ctes("""
    select query_id, epoch_us(asked_at) as at_us, round(best_score,6) as best_score from (
      select *, row_number() over (partition by date_trunc('minute', asked_at) order by asked_at, query_id) as rn from (
        select event_id as query_id, create_time - to_seconds((n%50)::int) as asked_at, value/500 as best_score from event)
      where best_score<0.5) where rn<=1""", "event"))
def bypass_search(t):
    best = t.event.select(F.col("event_id").alias("query_id"), (F.col("create_time") - F.make_dt_interval(secs=F.col("n") % 50)).alias("asked_at"),
                          (F.col("value") / 500).alias("best_score"))
    return search.bypass_grants(best).select("query_id", us("asked_at", "at_us"), r6("best_score", "best_score"))


# -- scoring -------------------------------------------------------------------
_RRF = f"""select query_id, event_id, abstract_coverage, text_len, score,
    row_number() over (partition by query_id order by score desc, event_id)::int as place from (
    select *, 1.0::double/(60+row_number() over (partition by query_id order by distance, event_id))*{_FACTOR}*{_MOOD} as score from hits)
  qualify place<=60"""


@query("rrf_single", with_ctes("select query_id, event_id, place, round(score,6) as score from scored", "hits", scored=_RRF))
def rrf_single(t):
    return recall.rrf_single(t.hits).select("query_id", "event_id", "place", r6("score", "score"))


@query("rrf_dual", with_ctes(f"""
    select query_id, event_id, place, round(score,6) as score from (
      select *, row_number() over (partition by query_id order by score desc, event_id)::int as place from (
        select coalesce(a.query_id,b.query_id) as query_id, coalesce(a.event_id,b.event_id) as event_id,
          (coalesce(1.0::double/(60+a.r),0)+coalesce(1.0::double/(60+b.r),0))
            *(case when b.r is not null then (1+0.5*log10(1+greatest(b.weight,0))) else 1 end)
            *(case when coalesce(a.event_valence,b.event_valence)*coalesce(a.query_valence,b.query_valence)>0
              then 1+0.2*coalesce(a.event_valence,b.event_valence)*coalesce(a.query_valence,b.query_valence) else 1 end) as score
        from sa a full join sb b on a.query_id=b.query_id and a.event_id=b.event_id)) where place<=60""", "hits",
    sa="select *, row_number() over (partition by query_id order by distance, event_id) as r from hits where route<>2 qualify r<=60",
    sb="select * replace (1-distance as distance), row_number() over (partition by query_id order by 1-distance, event_id) as r from hits where route<>0 qualify r<=60"))
def rrf_dual(t):
    a = t.hits.filter("route <> 2")
    b = t.hits.filter("route <> 0").withColumn("distance", 1 - F.col("distance"))
    return recall.rrf_dual(a, b).select("query_id", "event_id", "place", r6("score", "score"))


@query("budget_prefix", with_ctes("""
    select query_id, event_id, position, used from (select query_id, event_id, row_number() over w::int as position,
        (sum(text_len) over w)::bigint as used from scored where text_len>0
        window w as (partition by query_id order by score desc, event_id rows unbounded preceding))
    where used<=20000 or position=1""", "hits", scored=_RRF))
def budget_prefix(t):
    return recall.budget_prefix(recall.rrf_single(t.hits), CFG.redline).select("query_id", "event_id", "position", "used")


@query("head_tail_split", with_ctes("""
    select query_id, event_id, place as position, place<=floor(n*0.66::double) as is_head
    from (select *, count(*) over (partition by query_id) as n from scored)""", "hits", scored=_RRF))
def head_tail_split(t):
    block = recall.rrf_single(t.hits).select("query_id", "event_id", F.col("place").alias("position"))
    return recall.head_tail(block).select("query_id", "event_id", "position", "is_head")


@query("coverage_weight", with_ctes(f"select event_id, round({_COVER},6) as weight from event", "event"))
def coverage_weight(t):
    return t.event.select("event_id", r6(scoring.coverage_weight(F.col("abstract_coverage")), "weight"))


@query("mood_modifier", with_ctes(f"select query_id, event_id, round({_MOOD},6) as mood from hits", "hits"))
def mood_modifier(t):
    return t.hits.select("query_id", "event_id", r6(affect.mood_modifier(F.col("event_valence"), F.col("query_valence")), "mood"))


@query("hybrid_score", with_ctes(f"""
    select event_id, round(d,6) as time_decay, round(b,6) as role_boost, round(0.5*(1-value/500)+0.15*d+0.2*b+0.1*least(a,1.0)+0.05*least(a*1.5,1.0),6) as total
    from (select event_id, value, exp(-0.693*{AGE_DAYS.format(a='e.create_time', b=_ASOF)}/30.0) as d,
        max(case importance when 'S' then 0.3 when 'A' then 0.2 when 'B' then 0.1 when 'C' then 0.05 else 0.0 end)::double as b, max(arousal) as a
      from event e join event_role r using (event_id) group by event_id, value, e.create_time)""", "event", "event_role", "clock"))
def hybrid_score(t):
    per = t.event_role.groupBy("event_id").agg(F.max(scoring.importance_boost(F.col("importance"))).alias("b"), F.max("arousal").alias("a"))
    rows = t.event.join(per, "event_id")
    parts = scoring.hybrid_parts(1 - F.col("value") / 500, F.col("create_time"), t.as_of, F.col("b"), F.least("a", F.lit(1.0)),
                                 F.least(F.col("a") * 1.5, F.lit(1.0)))
    return rows.select("event_id", *[r6(c, n) for n, c in parts.items()])


@query("percentile_linear", with_ctes("""
    select event_type, round(quantile_cont(value,0.9),6) as p90, round(quantile_cont(value,0.37),6) as p37 from event group by event_type""", "event"))
def percentile_linear(t):
    return exact_percentiles(t.event, ["event_type"], "value", {"p90": 0.9, "p37": 0.37}).select("event_type", r6("p90", "p90"), r6("p37", "p37"))


@query("distance_cap", with_ctes("""
    select query_id, round(least(greatest(0.45,least(2.0,quantile_cont(distance,0.9))), 2+0.08*(0.3-0.5)),6) as cap from hits group by query_id""", "hits"))
def distance_cap(t):
    quality = scoring.quality_cap(scoring.quality_signal(F.lit(None).cast("double"), F.lit(0.3)))
    return recall.distance_cap(t.hits, quality).select("query_id", r6("cap", "cap"))


@query("quality_cap", with_ctes("""
    select event_id, round(s,6) as signal, round(greatest(0.45,least(2.0, 2.0+0.08*(s-0.5))),6) as cap from (
      select event_id, coalesce(0.1::double*a+0.9::double*b, a, b, 0.5) as s from (
        select event_id, case when n%3>0 then (n%100)/100::double end as a, case when n%5>0 then k/100::double end as b from event))""", "event"))
def quality_cap(t):
    a = F.when(F.col("n") % 3 > 0, (F.col("n") % 100) / 100)
    b = F.when(F.col("n") % 5 > 0, F.col("k") / 100)
    s = scoring.quality_signal(a, b)
    return t.event.select("event_id", r6(s, "signal"), r6(scoring.quality_cap(s), "cap"))


def user_focus(t):
    """Each user's query looks at the user and one key role."""
    q = t.event.select("user_id").distinct()
    return q.select(F.concat(F.lit("Q-"), "user_id").alias("query_id"), F.explode(F.array(
        F.when(F.col("user_id") % 3 > 0, F.concat(F.lit("ROL-U"), "user_id")), F.when(F.col("user_id") % 3 > 0, F.concat(F.lit("ROL-K"), F.col("user_id") % 100)))).alias("role_id")
    ).filter(F.col("role_id").isNotNull())


USER_FOCUS = """select distinct 'Q-'||user_id as query_id, unnest(['ROL-U'||user_id, 'ROL-K'||(user_id%100)]) as role_id from event where user_id%3>0"""
OFFSETS = """select h.query_id, h.event_id, (case when not exists (select 1 from focus f where f.query_id=h.query_id) then 0
    when best>=4 then -1 when best=3 then 0 else 1 end)::int as off from hits h
  left join (select f.query_id, r.event_id, max(rank) as best from focus f join event_role r using (role_id) group by all) b
    on b.query_id=h.query_id and b.event_id=h.event_id"""


@query("tier_offset", with_ctes("select query_id, event_id, off as tier from offs", "hits", "event_role", focus=USER_FOCUS, offs=OFFSETS))
def tier_offset(t):
    return recall.tier_offsets(t.hits.select("query_id", "event_id"), t.event_role, user_focus(t)).select(
        "query_id", "event_id", F.col("offset").alias("tier"))


_PICK_FROM = "select event_id, n, [s1,s2,s3,s4] as lv, content_raw, n%3-1 as off, 30+(n*53)%1500 as budget, least(greatest(2+n%3-1,0),3)+1 as p0 from event_text"
_PICKED = """select event_id, case when down is not null then down when p0<3 and up is not null then up when any_ is not null then any_ else 0 end as k, lv from (
  select *, (select min(i) from range(1,5) r(i) where i>=p0 and length(lv[i])<=budget and
      not exists (select 1 from range(1,5) s(j) where j>=p0 and j<i and length(lv[j])<=20)) as down,
    (select max(i) from range(1,5) r(i) where i<=p0 and length(lv[i])<=budget) as up,
    (select max(i) from range(1,5) r(i) where length(lv[i])<=budget) as any_ from src)"""


@query("summary_pick", with_ctes(
    "select event_id, case when k=0 then '' else 'L'||k end as level, md5(case when k=0 then '' else lv[k] end) as text_md5 from picked",
    "event_text", src=_PICK_FROM, picked=_PICKED))
def summary_pick(t):
    n = F.col("n")
    p = recall.summary_pick(recall.level_array(F.col("summaries")), F.col("content_raw"), F.lit(30) + (n * 53) % 1500, (n % 3 - 1).cast("int"))
    return t.event_text.select("event_id", p.alias("p")).select("event_id", "p.level", F.md5("p.text").alias("text_md5"))


@query("mid_tier_pick", with_ctes("""
    select event_id, least(greatest(2+n%5-2,0),3)::int as tier, md5([s1,s2,s3,s4][least(greatest(2+n%5-2,0),3)+1]) as text_md5 from event_text""", "event_text"))
def mid_tier_pick(t):
    lv = recall.level_array(F.col("summaries"))
    at = recall.mid_tier(lv, (F.col("n") % 5 - 2).cast("int"))
    return t.event_text.select("event_id", at.alias("tier"), F.md5(F.get(lv, at)["v"]).alias("text_md5"))


@query("context_assemble", with_ctes("""
    select query_id, md5(array_to_string(list_filter([
      case when recall is not null then '[历史回忆]'||chr(10)||recall end, case when shadow<>'' then '[残影缓冲]'||chr(10)||shadow end,
      '[当前输入]'||chr(10)||query_id], lambda x: x is not null), chr(10)||chr(10))) as context_md5
    from (select query_id, string_agg(event_id||' '||text_len, chr(10)||'---'||chr(10) order by place) as recall,
        case when min(text_len)%2=0 then 'shadow of '||query_id else '' end as shadow from scored group by query_id)""", "hits", scored=_RRF))
def context_assemble(t):
    from memlake.plans.recall_block import context_package
    block = recall.rrf_single(t.hits).select("query_id", F.col("place").alias("position"), "text_len",
                                             F.concat_ws(" ", "event_id", "text_len").alias("text"))
    q = block.groupBy("query_id").agg(F.min("text_len").alias("m")).select(
        "query_id", F.when(F.col("m") % 2 == 0, F.concat(F.lit("shadow of "), "query_id")).otherwise("").alias("shadow"), F.col("query_id").alias("text"))
    return context_package(block, q).select("query_id", F.md5("context").alias("context_md5"))


# -- intent --------------------------------------------------------------------
def _hits_sql(col: str, terms) -> str:
    return "(" + "+".join(f"contains(lower({col}),'{w.lower()}')::int" for w in terms) + ")"


_SIGNALS = f"""select doc_id, {_hits_sql('text', ENTITY_TERMS)} as ent, {_hits_sql('text', EMOTION_TERMS)} as emo,
  {_hits_sql('text', FACT_TERMS)} as fact from documents"""


@query("lexicon_hits", with_ctes("select doc_id, ent::int as ent, emo::int as emo, fact::int as fact from sig", sig=_SIGNALS))
def lexicon_hits(t):
    x = F.col("text")
    return t.raw("documents").select("doc_id", tx.term_hits(x, ENTITY_TERMS).alias("ent"), tx.term_hits(x, EMOTION_TERMS).alias("emo"),
                                     tx.term_hits(x, FACT_TERMS).alias("fact"))


@query("intent_regex", f"""select doc_id, case when regexp_matches(text,'(?i){ENTITY_PATTERN}') then 'entity_trace'
    when regexp_matches(text,'(?i){EMOTION_PATTERN}') then 'emotion' else 'fact' end as intent from documents""")
def intent_regex(t):
    return t.raw("documents").select("doc_id", tx.hard_intent(F.col("text")).alias("intent"))


@query("intent_blend", with_ctes("""
    select doc_id, label, round(0.1*a+0.2*b+0.7*c,6) as w_act, round(0.6*b+0.1*c,6) as w_emo, round(0.9*a+0.2*b+0.2*c,6) as w_ent from (
      select doc_id, exp(ent-m)/z as a, exp(emo-m)/z as b, exp(fact+1-m)/z as c,
        case when ent=m then 'blend:entity' when emo=m then 'blend:emotion' else 'blend:fact' end as label from (
        select *, exp(ent-m)+exp(emo-m)+exp(fact+1-m) as z from (select *, greatest(ent,emo,fact+1) as m from sig)))""", sig=_SIGNALS))
def intent_blend(t):
    x = F.col("text")
    sig = t.raw("documents").select("doc_id", tx.term_hits(x, ENTITY_TERMS).alias("ent"), tx.term_hits(x, EMOTION_TERMS).alias("emo"),
                                    tx.term_hits(x, FACT_TERMS).alias("fact"))
    mix = scoring.intent_blend(F.col("ent"), F.col("emo"), F.col("fact"))
    return sig.select("doc_id", "ent", "emo", "fact", *[c.alias(n) for n, c in mix.items()]).select(
        "doc_id", "label", r6("w_act", "w_act"), r6("w_emo", "w_emo"), r6("w_ent", "w_ent"))


_PROTO = "greatest(list_cosine_similarity(v, list_transform(range(64), lambda j: sin((j+1)*{c}))), 0.0)"


@query("intent_prototypes", with_ctes(f"""
    select doc_id, label, round(0.1*a+0.2*b+0.7*c,6) as w_act, round(0.6*b+0.1*c,6) as w_emo, round(0.9*a+0.2*b+0.2*c,6) as w_ent from (
      select doc_id, exp(ent-m)/z as a, exp(emo-m)/z as b, exp(fact-m)/z as c,
        case when ent=m then 'blend:entity' when emo=m then 'blend:emotion' else 'blend:fact' end as label from (
        select *, exp(ent-m)+exp(emo-m)+exp(fact-m) as z from (select *, greatest(ent,emo,fact) as m from (
          select doc_id, ent+2*greatest({_PROTO.format(c=1)}, {_PROTO.format(c=4)}) as ent, emo+2*{_PROTO.format(c=2)} as emo, fact+1+2*{_PROTO.format(c=3)} as fact
          from sig join (select embedding::double[] as v, row_number() over (order by vec_id)-1 as i from embeddings) on i = doc_id % (select count(*) from embeddings)))))""", sig=_SIGNALS))
def intent_prototypes(t):
    example = lambda c: [math.sin((j + 1) * c) for j in range(64)]
    n = t.raw("embeddings").count()
    given = t.raw("embeddings").select(F.col("embedding").cast("array<double>").alias("v"), (F.row_number().over(Window.orderBy("vec_id")) - 1).alias("i"))
    x = F.col("text")
    docs = t.raw("documents").withColumn("i", F.col("doc_id") % n).join(given, "i")
    sig = docs.select("doc_id", *[tx.term_hits(x, terms).alias(n) for n, terms in (("ent", ENTITY_TERMS), ("emo", EMOTION_TERMS), ("fact", FACT_TERMS))],
                      *[scoring.prototype_signal(F.col("v"), p).alias(n) for n, p in (("like_ent", [example(1), example(4)]), ("like_emo", [example(2)]), ("like_fact", [example(3)]))])
    mix = scoring.intent_blend(F.col("ent"), F.col("emo"), F.col("fact"), likeness=(F.col("like_ent"), F.col("like_emo"), F.col("like_fact")))
    return sig.select("doc_id", *[c.alias(k) for k, c in mix.items()]).select("doc_id", "label", r6("w_act", "w_act"), r6("w_emo", "w_emo"), r6("w_ent", "w_ent"))

"""Sentences, segmentation, splitting, budgets, parsed answers."""

from pyspark.sql import functions as F

from memlake.config import DEFAULT as CFG
from memlake.functions import answers, scoring, text as tx
from memlake.mappings import scalar, with_ctes
from memlake.operators import segment
from memlake.registry.core import query, r6, us

_TRIM = r"regexp_replace({x}, '^\s+|\s+$', '', 'g')"
_SENT = rf"""select doc_id, list_filter(list_transform(regexp_extract_all(text, '[^。！？；!?\n]*[。！？；!?\n]|[^。！？；!?\n]+$'),
  lambda x: {_TRIM.format(x='x')}), lambda x: x<>'') as s, text from documents"""


@query("segment_sentences", with_ctes("select doc_id, len(s)::int as n, md5(array_to_string(s,'|')) as sentences_md5 from sent", sent=_SENT))
def segment_sentences(t):
    out = t.raw("documents").select("doc_id", tx.sentences(F.col("text")).alias("s"))
    return out.select("doc_id", F.size("s").alias("n"), F.md5(F.array_join("s", "|")).alias("sentences_md5"))


@query("index_sentences", with_ctes(
    "select doc_id, md5(array_to_string(list_transform(s, lambda x, i: '['||i||'] '||x), chr(10))) as lines_md5 from sent", sent=_SENT))
def index_sentences(t):
    return t.raw("documents").select("doc_id", F.md5(tx.numbered(tx.sentences(F.col("text")))).alias("lines_md5"))


@query("decode_indices", with_ctes(
    "select doc_id, md5(array_to_string(list_transform(list_filter([3,1,0,doc_id%7,999999,2], lambda i: i>=1 and i<=len(s)), lambda i: s[i]), '')) as picked_md5 from sent",
    sent=_SENT))
def decode_indices(t):
    ix = F.array(F.lit(3), F.lit(1), F.lit(0), (F.col("doc_id") % 7).cast("int"), F.lit(999999), F.lit(2))
    out = t.raw("documents").select("doc_id", tx.sentences(F.col("text")).alias("s"), ix.alias("ix"))
    return out.select("doc_id", F.md5(tx.pick_sentences(F.col("s"), F.col("ix"))).alias("picked_md5"))


_DONE = ("""{"completed_events":[{"content_raw_indices":[1,2],"continuation_of":"UC-'||doc_id||'","is_split_prefix":true,"split_id":"S-'||doc_id||'"},"""
         """{"content_raw_indices":[3],"is_split_prefix":true},{"content_raw_indices":[0,999999]}],""")


def _answer_sql():
    return f"""select 'T-'||doc_id as turn_id, doc_id, s, doc_id%3 as w, '{_DONE}' as answer_head from sent"""


@query("boundary_decode", with_ctes("""
    select turn_id, state, content, split_id, is_prefix, continuation_of from (
      select turn_id, 'completed' as state, array_to_string(s[1:2],'') as content, 'S-'||doc_id as split_id, true as is_prefix, 'UC-'||doc_id as continuation_of from ans
      union all select turn_id, 'completed', coalesce(s[3],''), null, false, null from ans
      union all select turn_id, 'unclosed', array_to_string(s[4:5],''), 'O-'||doc_id, false, null from ans where w=0
      union all select turn_id, 'unclosed', array_to_string(s[4:5],''), null, false, null from ans where w=1
      union all select turn_id, 'unclosed', coalesce(s[4],''), null, false, null from ans where w=2
      union all select turn_id, 'unclosed', coalesce(s[5],''), null, false, null from ans where w=2) where content<>''""",
    sent=_SENT, ans=_answer_sql()))
def boundary_decode(t):
    d = F.col("doc_id").cast("string")
    head = F.concat(*[F.lit(p) if i % 2 == 0 else d for i, p in enumerate(
        x for piece in _DONE.split("'||doc_id||'") for x in (piece, None))][:-1])
    tail = (F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit('"new_unclosed":[{"indices":[4,5],"split_id":"O-'), d, F.lit('"},{"indices":[]}]}')))
            .when(F.col("doc_id") % 3 == 1, F.lit('"new_unclosed_indices":[4,5]}')).otherwise(F.lit('"new_unclosed_indices":[[4],[5]]}')))
    rows = t.raw("documents").select(F.concat(F.lit("T-"), d).alias("turn_id"), "text", F.concat(head, tail).alias("answer"))
    return segment.boundary_decode(rows).select("turn_id", "state", "content", "split_id", "is_prefix", "continuation_of")


@query("canonical_equal", r"""
    select doc_id, regexp_replace(text,'\s+','','g')=regexp_replace('  '||replace(text,' ',chr(10)||' '||chr(9))||chr(10),'\s+','','g') as spaced_equal,
      regexp_replace(text,'\s+','','g')='' as cut_equal, regexp_replace(text,'\s+','','g')=regexp_replace(case when doc_id%2=0 then text||chr(9) else left(text,length(text)-1) end,'\s+','','g') as last_equal
    from documents""")
def canonical_equal(t):
    x = F.col("text")
    spaced = F.concat(F.lit("  "), F.replace(x, F.lit(" "), F.lit("\n \t")), F.lit("\n"))
    return t.raw("documents").select("doc_id", tx.same_text(x, spaced).alias("spaced_equal"),
                                     tx.same_text(x, F.concat(x, x)).alias("cut_equal"), tx.same_text(x, F.when(
                                         F.col("doc_id") % 2 == 0, F.concat(x, F.lit("\t"))).otherwise(F.left(x, F.length(x) - 1))).alias("last_equal"))


@query("shadow_build", with_ctes("""
    select conv_id, length(x)::bigint as shadow_chars, md5(right(x,4000)) as shadow_md5
    from (select conv_id, string_agg(text, chr(10) order by ts, turn) as x from turns group by conv_id)""", "turns"))
def shadow_build(t):
    return segment.open_shadow(t.turn).select("conv_id", F.col("shadow_chars").cast("long").alias("shadow_chars"), F.md5("shadow").alias("shadow_md5"))


@query("ultra_stub", "select doc_id, '[DOC-'||doc_id||'] '||left(text,40)||'…' as stub from documents")
def ultra_stub(t):
    return t.raw("documents").select("doc_id", tx.stub(F.concat(F.lit("DOC-"), "doc_id"), F.col("text")).alias("stub"))


@query("act_text", with_ctes("""
    select event_id, md5(left(case n%3 when 0 then s2 when 1 then s1 else content_raw end,4000)) as act_md5 from event_text""", "event_text"))
def act_text(t):
    k = F.col("n") % 3
    some = F.when(k == 0, F.col("summaries")).when(k == 1, F.map_filter("summaries", lambda key, _: key != "L2")).otherwise(
        F.create_map(F.lit("L1"), F.lit("")))
    return t.event_text.select("event_id", F.md5(tx.act_text(some, F.col("content_raw"))).alias("act_md5"))


_B = """select doc_id, n, greatest(floor(n*(0.1515::double+0.8485::double*exp(-n/500::double))),60)::int as total from (select doc_id, length(text) as n from documents)"""


@query("compression_budget", with_ctes("""
    select doc_id, total, l1 as "L1", greatest(l1//2,35)::int as "L2", greatest(l1//8,35)::int as "L4", greatest(l1//512,35)::int as "L10", s3 as "snap_L3",
      greatest(floor(s3*0.6::double),15)::int as "snap_L2", greatest(floor(greatest(floor(s3*0.6::double),15)*0.6::double),10)::int as "snap_L1",
      greatest(floor(total*0.25::double/2),10)::int as wp, greatest(floor(total*0.1::double),10)::int as decoration,
      greatest(floor(n*0.1515::double),35)::int as abstract_l1
    from (select *, greatest(floor(total*0.4::double),35)::int as l1, greatest(floor(total*0.25::double/2),30)::int as s3 from b)""", b=_B))
def compression_budget(t):
    n = F.length("text")
    b = scoring.budget(n)
    return t.raw("documents").select("doc_id", *[b[k].alias(k) for k in (
        "total", "L1", "L2", "L4", "L10", "snap_L3", "snap_L2", "snap_L1", "wp", "decoration")], scoring.budget(n, abstract=True)["L1"].alias("abstract_l1"))


@query("split_ratio_check", """
    select doc_id, round(r,6) as ratio, case when r<0.7::double-0.05::double or r>0.9::double+0.05::double then 'reject' when r<0.7 or r>0.9 then 'warn' else 'accept' end as verdict
    from (select doc_id, (length(text)*(60+doc_id%40)//100)/length(text)::double as r from documents)""")
def split_ratio_check(t):
    cut = F.floor(F.length("text") * (60 + F.col("doc_id") % 40) / 100).cast("int")
    rows = t.raw("documents").select("doc_id", F.substr("text", F.lit(1), cut).alias("p"), F.substr("text", cut + 1).alias("q"))
    s = segment.split_ratio(F.col("p"), F.col("q"))
    return rows.select("doc_id", r6(s["ratio"], "ratio"), s["verdict"].alias("verdict"))


_CUT = r"""select doc_id, text, n, low, mid, high,
    mid - length(regexp_extract(l, '[^.。！？；!?\n]*$')) as c1, length(regexp_extract(l, '[^.。！？；!?\n]*$')) < length(l) as ok1,
    mid + length(regexp_extract(r, '^[^.。！？；!?\n]*[.。！？；!?\n]')) as c2, length(regexp_extract(r, '^[^.。！？；!?\n]*[.。！？；!?\n]'))>0 as ok2
  from (select *, substr(text, low, mid-low+1) as l, substr(text, mid+1, high-mid) as r from (
    select doc_id, text, length(text) as n, ceil(length(text)*70/100.0)::bigint as low, (length(text)*80)//100 as mid, (length(text)*90)//100 as high
    from documents where length(text)>2400))"""
_CUTS = "select doc_id, text, n, case when ok1 and (not ok2 or n*80-c1*100 <= c2*100-n*80) then c1 when ok2 then c2 end as cut from cand"


@query("split_overlong", with_ctes("""
    select 'FRG-'||doc_id as fragment_id, 'whole' as kind, length(text)::int as chars, md5(text) as content_md5, length(text)>2400 as oversized, null as split_id
    from documents where doc_id not in (select doc_id from cuts where cut is not null)
    union all select 'FRG-'||doc_id, 'prefix', cut::int, md5(left(text,cut)), cut>2400, 'SPL-FRG-'||doc_id from cuts where cut is not null
    union all select 'FRG-'||doc_id, 'tail', (n-cut)::int, md5(substr(text,cut+1)), n-cut>2400, 'SPL-FRG-'||doc_id from cuts where cut is not null""",
    cand=_CUT, cuts=_CUTS))
def split_overlong(t):
    return segment.split_overlong(t.fragment.select("fragment_id", "content")).select(
        "fragment_id", "kind", F.length("content").alias("chars"), F.md5("content").alias("content_md5"), "oversized", "split_id")


@query("boundary_audit", with_ctes("""
    select fragment_id as subject, case when split_id is null then 'oversized_uc' else 'split_tail_still_oversized' end as code, 'error' as severity, '' as side
    from fragment where length(content)>2400
    union all select split_id, 'broken_split_pair', 'error', case when bool_or(kind='prefix') then 'prefix' else 'tail' end from fragment
      where split_id is not null group by split_id having bool_or(kind='prefix')<>bool_or(kind='tail')
    union all select split_id, 'split_ratio_off', 'warn', '' from (select split_id, sum(length(content)) filter (where kind='prefix') as p,
      sum(length(content)) filter (where kind='tail') as q from fragment where split_id is not null group by split_id)
      where p/(p+q)::double<0.7 or p/(p+q)::double>0.9""", "fragment"))
def boundary_audit(t):
    return segment.boundary_audit(t.fragment)


@query("segment_stream", with_ctes("""
    select conv_id, session_no, count(*) as turns, sum(length(text))::bigint as chars, epoch_us(min(ts)) as start_us, epoch_us(max(ts)) as end_us,
      session_no < max(session_no) over (partition by conv_id) or epoch_us((select max(ts) from turns))-epoch_us(max(ts))>1800000000
        or right(regexp_replace(arg_max(text,(ts,turn)), '\\s+$', ''),1) in ('.','。','！','？','；','!','?') as is_closed
    from (select *, sum(new) over (partition by conv_id order by ts, turn rows unbounded preceding)::bigint as session_no from (
      select *, case when coalesce(epoch_us(ts)-epoch_us(lag(ts) over (partition by conv_id order by ts, turn))>1800000000, true) then 1 else 0 end as new from turns))
    group by conv_id, session_no""".replace("\\\\s", r"\s"), "turns"))
def segment_stream(t):
    return segment.segment_turns(t.turn, 30, scalar(t.turn, F.max("ts"))).select(
        "conv_id", "session_no", "turns", "chars", us("start_time", "start_us"), us("end_time", "end_us"), "is_closed")


@query("redline_compact", with_ctes("""
    select conv_id, turn, case when total<=20000 then 'keep' when length(x)>=2400 then 'seal'
      when ts < (select max(ts) from turns)-interval 24 hour then 'drop' else 'keep' end as action
    from (select conv_id, turn, ts, repeat(text,3) as x, sum(length(text)*3) over (partition by conv_id) + 5000 as total from turns)""", "turns"))
def redline_compact(t):
    rows = t.turn.select(F.col("conv_id").alias("owner"), "turn", F.repeat("text", F.lit(3)).alias("content"), F.col("ts").alias("last_hit_time"))
    return segment.redline_compact(rows, F.lit(5000), scalar(t.turn, F.max("ts"))).select(F.col("owner").alias("conv_id"), "turn", "action")


_REDLINE = """select conv_id, turn, x, case when total<=20000 then 'keep' when length(x)>=2400 then 'seal'
    when ts < (select max(ts) from turns)-interval 24 hour then 'drop' else 'keep' end as action, total
  from (select conv_id, turn, ts, repeat(text,3) as x, sum(length(text)*3) over (partition by conv_id) + least(sum(length(text)) over (partition by conv_id)*2, 90000) as total from turns)"""


@query("redline_rows", with_ctes("""
    select 'sealed' as kind, conv_id, turn, md5(left(x,2000)) as text_md5, case when turn%2=1 then 'EVT-'||(turn-1) else '' end as prefixes from judged where action='seal'
    union all select 'open', conv_id, turn, md5(x), case when turn%2=1 then 'EVT-'||(turn-1) else '' end from judged where action='keep'
    union all select 'shadow', conv_id, -1, md5(case when total>20000 then right(s,4000) else s end), '' from (
      select conv_id, repeat('s', least(sum(length(text))*2, 90000)::int-1)||'!' as s from turns group by conv_id) join (select distinct conv_id, total from judged) using (conv_id)""",
    "turns", judged=_REDLINE))
def redline_rows(t):
    rows = t.turn.select(F.col("conv_id").alias("owner"), F.col("turn").alias("item"), F.repeat("text", F.lit(3)).alias("content"), F.col("ts").alias("last_hit_time"),
                         F.when(F.col("turn") % 2 == 1, F.array(F.concat(F.lit("EVT-"), F.col("turn") - 1))).alias("split_prefix_event_ids"))
    size = F.least(F.sum(F.length("text")) * 2, F.lit(90000)).cast("int")
    shadow = t.turn.groupBy(F.col("conv_id").alias("owner")).agg(F.concat(F.repeat(F.lit("s"), size - 1), F.lit("!")).alias("shadow"))
    sealed, kept, left = segment.redline_rows(rows, shadow, scalar(t.turn, F.max("ts")))
    row = lambda kind, df, item, text, prefixes: df.select(F.lit(kind).alias("kind"), F.col("owner").alias("conv_id"), item.cast("bigint").alias("turn"), F.md5(text).alias("text_md5"), prefixes.alias("prefixes"))
    before = F.array_join(F.coalesce("split_prefix_event_ids", F.array().cast("array<string>")), ",")
    return (row("sealed", sealed, F.col("item"), F.col("content_raw"), before).unionByName(row("open", kept, F.col("item"), F.col("content"), before))
            .unionByName(row("shadow", left, F.lit(-1), F.col("shadow"), F.lit(""))))


@query("force_save", with_ctes("""
    select conv_id, 'shadow' as source, md5(left(x,2000)) as content_md5 from (select conv_id, string_agg(text, chr(10) order by turn)||chr(10)||'now '||conv_id as x from turns group by conv_id)
    union all select conv_id, 'open-'||turn, md5(left(text,2000)) from turns where trim(text)<>''""", "turns"))
def force_save(t):
    opened = t.turn.select(F.col("conv_id").alias("owner"), F.col("turn").alias("item"), F.col("text").alias("content"))
    now = t.turn.select(F.col("conv_id").alias("owner"), F.concat(F.lit("now "), "conv_id").alias("text")).distinct()
    return segment.force_save(opened, now).select(F.col("owner").alias("conv_id"), "source", F.md5("content_raw").alias("content_md5"))


_LEAD = r"""case when length({p})<=b{k} then {p} when length(regexp_extract(left({p},b{k}), '(?s)^.*[.。！？；!?\n]'))>0
  then regexp_extract(left({p},b{k}), '(?s)^.*[.。！？；!?\n]') else left({p},b{k}) end"""


def _ladder_sql() -> str:
    sql = "select doc_id, text as s0, " + ", ".join(f"greatest(l1//{2 ** (k - 1)},35)::int as b{k}" for k in range(1, 11)) + \
          " from (select doc_id, text, greatest(floor(total*0.4::double),35)::int as l1 from b join documents using (doc_id))"
    for k in range(1, 11):
        live = "true" if k == 1 else f"length(s{k - 1})>35"
        sql = f"select *, case when {live} then {_LEAD.format(p=f's{k - 1}', k=k)} end as s{k} from ({sql})"
    return sql


@query("summary_ladder", with_ctes("""
    select doc_id, len(v)::int as actual_max_level, md5(array_to_string(v,'|')) as ladder_md5 from (
      select doc_id, list_filter([s1,s2,s3,s4,s5,s6,s7,s8,s9,s10], lambda x: x is not null and x<>'') as v from ladder)""", b=_B, ladder=_ladder_sql()))
def summary_ladder(t):
    rows = t.raw("documents").select("doc_id", F.col("text").alias("content_raw"))
    out = segment.summary_ladder(rows)
    texts = F.filter(F.array(*[F.col("summaries")[f"L{k}"] for k in range(1, 11)]), lambda x: x.isNotNull())
    return out.select("doc_id", "actual_max_level", F.md5(F.array_join(texts, "|")).alias("ladder_md5"))


# -- parsed answers -------------------------------------------------------------
_CLEAN = r"""select conv_id, turn, regexp_replace(text, '[\s"\\]+', ' ', 'g') as s from conversations"""


def clean_turns(t):
    return t.raw("conversations").select("conv_id", "turn", F.regexp_replace("text", r'[\s"\\]+', " ").alias("s"))


@query("summary_parse", with_ctes(r"""
    select conv_id, turn, (case when trim(s)='' then 1 else 2 end)::int as levels, md5(regexp_replace(s,'^\s+|\s+$','','g')) as l1_md5, length(regexp_replace(s,'^\s+|\s+$','','g'))::int as l1_chars
    from c where trim(s)<>''""", c=_CLEAN))
def summary_parse(t):
    raw = F.concat(F.lit('{"L1": "'), F.col("s"), F.lit(' ", "L2": " short ", "L3": "  ", "Lx": "no", "note": "no", "L4": null}'))
    out = clean_turns(t).filter(tx.strip(F.col("s")) != "").select("conv_id", "turn", answers.summary_parse(raw).alias("m"))
    return out.select("conv_id", "turn", F.size("m").alias("levels"), F.md5(F.col("m")["L1"]).alias("l1_md5"), F.length(F.col("m")["L1"]).alias("l1_chars"))


@query("role_parse", with_ctes("""
    select conv_id, turn, 0 as pos, 'Ann' as name, 'person' as entity_type, 'S' as importance, 'seen' as l1_mention,
      round(greatest(0.25, (turn%10)/10.0),6)::double as arousal, round(((turn%10)/10.0-0.25)/((turn%10)/10.0+0.25+1e-6),6)::double as valence, 2 as names from c
    union all select conv_id, turn, 1, 'P'||conv_id, 'place', 'C', null, 0.0, 0.0, 2 from c""", c=_CLEAN))
def role_parse(t):
    raw = F.concat(F.lit('[{"name":"Ann","importance":"S","snapshot":{"l1_mention":"seen"},"emotion":{"joy":'), (F.col("turn") % 10 / 10).cast("string"),
                   F.lit(',"fear":"0.25","anger":"very"}},{"name":"P'), F.col("conv_id").cast("string"), F.lit('","entity_type":"place","importance":"Z"}]'))
    listed = F.concat(F.lit('["Ann"," Ann ",{"name":"P'), F.col("conv_id").cast("string"), F.lit('"},""]'))
    rows = clean_turns(t).select(F.struct("conv_id", "turn").alias("key"), raw.alias("raw"), F.size(answers.role_names(listed)).alias("names"))
    out = answers.role_parse(rows, "key", "raw").join(rows.select("key", "names"), "key")
    return out.select("key.conv_id", "key.turn", "pos", "name", "entity_type", "importance", "l1_mention", r6("arousal", "arousal"), r6("valence", "valence"), "names")

"""Evidence graphs, coverage, shadowing, split chains."""

from pyspark.sql import Window, functions as F

from memlake.config import DEFAULT as CFG
from memlake.functions import vectors
from memlake.mappings import EPOCH, scalar, with_ctes
from memlake.operators import graph, recall, roles
from memlake.registry.core import query, r6, us
from memlake.sources import lake

_LEAF = "select root, event_id from graph_leaf union select event_id, event_id from graph_node where not is_abstract and not is_tombstoned"


def all_leaves(t):
    return graph.leaf_resolve(t.graph_node, t.graph_edge, t.graph_node)


@query("leaf_resolve", with_ctes("select * from leaf", "graph_leaf", leaf=_LEAF))
def leaf_resolve(t):
    return all_leaves(t).select("root", "event_id")


# -- orders as abstract events over parts ----------------------------------------
def basket_nodes(t):
    orders = t.raw("orders").select(
        F.concat(F.lit("ORD-"), "o_orderkey").alias("event_id"), F.lit(True).alias("is_abstract"), F.lit(1).alias("level"),
        F.col("o_orderdate").alias("create_time"), F.col("o_orderpriority").alias("content_raw"), (F.col("o_orderkey") % 19 == 0).alias("is_tombstoned"))
    parts = t.raw("part").select(
        F.concat(F.lit("PRT-"), "p_partkey").alias("event_id"), F.lit(False).alias("is_abstract"), F.lit(0).alias("level"),
        (F.lit(EPOCH).cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("p_partkey") % 1000)).alias("create_time"),
        F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("content_raw"), (F.col("p_partkey") % 23 == 0).alias("is_tombstoned"))
    return orders.unionByName(parts)


def basket_members(t):
    return t.raw("orders").select(F.concat(F.lit("SUB-"), "o_custkey").alias("subset_id"), F.concat(F.lit("ORD-"), "o_orderkey").alias("member"))


_BNODE = f"""select 'ORD-'||o_orderkey as event_id, true as is_abstract, 1 as level, o_orderdate as create_time, o_orderpriority as content_raw,
    o_orderkey%19=0 as is_tombstoned from orders
  union all select 'PRT-'||p_partkey, false, 0, timestamp '{EPOCH}' + to_seconds(p_partkey%1000), p_name||' '||p_type||' '||p_brand, p_partkey%23=0 from part"""
_BEV = """select distinct 'SUB-'||o_custkey as subset_id, l.event_id, l.create_time, l.content_raw from orders o
  join basket_edge b on b.parent='ORD-'||o_orderkey join bnode l on l.event_id=b.child
  where o_orderkey%19<>0 and not l.is_tombstoned"""


def basket_evidence(t):
    return graph.evidence_collect(basket_nodes(t), t.basket_edge, basket_members(t), texts=False)


@query("evidence_collect", with_ctes("select subset_id, event_id, epoch_us(create_time) as at_us from bev", "basket_edge", bnode=_BNODE, bev=_BEV))
def evidence_collect(t):
    return basket_evidence(t).select("subset_id", "event_id", us("create_time", "at_us"))


_STATS = """select subset_id, count(*) as n, round_even(avg(length(content_raw)),0)::int as avg_len,
  greatest(1, floor(avg(length(content_raw))*1.2::double)::int) as target_len from bev group by subset_id"""


@query("leaf_evidence_stats", with_ctes("select * from stats", "basket_edge", bnode=_BNODE, bev=_BEV, stats=_STATS))
def leaf_evidence_stats(t):
    return graph.leaf_evidence_stats(basket_evidence(t))


@query("abstract_build", with_ctes("""
    select s.subset_id, 2 as abstraction_level, m.n as n_sources, s.n, avg_len, target_len, left(x, target_len) as content_raw, true as is_abstract
    from stats s join (select 'SUB-'||o_custkey as subset_id, count(*) as n from orders group by o_custkey) m using (subset_id)
    join (select subset_id, string_agg(content_raw, chr(10) order by create_time, event_id) as x from bev group by subset_id) using (subset_id)""",
    "basket_edge", bnode=_BNODE, bev=_BEV, stats=_STATS))
def abstract_build(t):
    return graph.abstract_build(basket_members(t), basket_nodes(t), basket_evidence(t))


@query("narrative_dedupe", with_ctes("""
    select subset_id, root as matched_id, round(m/n::double,6) as overlap, (n-m)::bigint as novelty from (
      select s.subset_id, r.root, r.create_time, count(*) as m, z.n from sl s join al using (event_id) join recent r using (root)
      join (select subset_id, count(*) as n from sl group by subset_id) z on z.subset_id=s.subset_id group by all)
    where m/n::double>=0.9 and not ((n-m)/n::double>=0.1 and n-m>=2)
    qualify row_number() over (partition by subset_id order by create_time desc, root desc)=1""", "basket_edge",
    sl="select 'SUB-'||parent as subset_id, child as event_id from basket_edge",
    al="select parent as root, child as event_id from basket_edge",
    recent="select 'ORD-'||o_orderkey as root, o_orderdate as create_time from orders order by o_orderdate desc, 'ORD-'||o_orderkey desc limit 200"))
def narrative_dedupe(t):
    sl = t.basket_edge.select(F.concat(F.lit("SUB-"), "parent").alias("subset_id"), F.col("child").alias("event_id"))
    al = t.basket_edge.select(F.col("parent").alias("root"), F.col("child").alias("event_id"))
    out = graph.narrative_dedupe(sl, al, basket_nodes(t).filter("is_abstract"))
    return out.select("subset_id", "matched_id", r6("overlap", "overlap"), "novelty")


# -- coverage and shadowing --------------------------------------------------------
_MEM = """select 'SUB-'||n_regionkey as subset_id, 'NAT-'||n_nationkey as member from nation
  union all select 'SUB-'||(c_custkey%5), 'CUS-'||c_custkey from customer"""


def region_members(t):
    nat = t.raw("nation").select(F.concat(F.lit("SUB-"), "n_regionkey").alias("subset_id"), F.concat(F.lit("NAT-"), "n_nationkey").alias("member"))
    cus = t.raw("customer").select(F.concat(F.lit("SUB-"), F.col("c_custkey") % 5).alias("subset_id"), F.concat(F.lit("CUS-"), "c_custkey").alias("member"))
    return nat.unionByName(cus)


@query("coverage_increment", with_ctes("""
    select event_id, round(case when gain is null then c0 else least(c0+gain, 3.0) end,6) as abstract_coverage
    from (select event_id, (key%3)*0.5::double as c0 from graph_node) left join (
      select event_id, sum(1/(1+ln(n))) as gain from touched join (select subset_id, count(*) as n from touched group by subset_id) using (subset_id)
      group by event_id) using (event_id)""", "graph_leaf", mem=_MEM, leaf=_LEAF,
    touched="""select distinct subset_id, event_id from (select subset_id, member as event_id from mem
      union all select subset_id, event_id from mem join leaf on root=member) join graph_node g using (event_id) where not g.is_tombstoned"""))
def coverage_increment(t):
    cov = t.graph_node.select("event_id", ((F.col("key") % 3) * 0.5).alias("abstract_coverage"))
    out = graph.coverage_increment(t.graph_node, t.graph_edge, region_members(t), cov)
    return out.select("event_id", r6("abstract_coverage", "abstract_coverage"))


@query("asf_propagate", with_ctes("""
    select event_id, round(case when s is null then a0 else least(0.999999, 1-(1-a0)*s) end,6) as asf
    from (select event_id, (key%10)/20::double as a0 from graph_node) left join (
      select l.event_id, exp(sum(ln(greatest(1-0.5*greatest(0, list_cosine_similarity(x.act, y.act)*least(1.0, length(r.content_raw)/length(b.content_raw)::double)),1e-12)))) as s
      from graph_leaf l join graph_node b on b.event_id=l.event_id join graph_node r on r.event_id=l.root
      join nv x on x.event_id=b.event_id join nv y on y.event_id=r.event_id where not b.ptsd_immune group by l.event_id) using (event_id)""",
    "graph_leaf", "vector", nv="select g.event_id, v.act from graph_node g join vector v on v.vec_id = g.key % (select count(*) from vector)"))
def asf_propagate(t):
    v = t.vector.select("vec_id", "act")
    nv = t.graph_node.withColumn("vec_id", F.col("key") % scalar(t.vector, F.count("*"))).join(v, "vec_id").select("event_id", "act")
    leaves = all_leaves(t).filter(F.col("root") != F.col("event_id"))
    old = t.graph_node.select("event_id", ((F.col("key") % 10) / 20).alias("asf"))
    return graph.asf_propagate(t.graph_node, leaves, nv, old).select("event_id", r6("asf", "asf"))


@query("mark_abstracted", with_ctes("select event_id, is_abstracted or value>=300 as is_abstracted from event", "event"))
def mark_abstracted(t):
    members = t.event.filter("value >= 300").select(F.col("event_id").alias("member"))
    return graph.mark_abstracted(t.event, members).select("event_id", "is_abstracted")


@query("entity_text", with_ctes("""
    select e.event_id, coalesce(x.t, e.event_id) as entity_text from (select event_id from event union all select distinct 'ABS-'||(n//7) from event) e
    left join (select event_id, string_agg(words, ' ' order by via, pos) as t from (
        select event_id, '' as via, pos, words from words where event_id in (select event_id from event where event_type<>'signup')
        union all select 'ABS-'||(n//7), event_id, pos, words from words join (select event_id, n from event where event_type<>'signup') using (event_id))
      group by event_id) x using (event_id)""", "event_role", "role",
    words="select event_id, pos, r.role_id||coalesce(' '||array_to_string([name]||aliases,' '),'') as words from event_role r left join role using (role_id)"))
def entity_text(t):
    leaves = t.event.select(F.concat(F.lit("ABS-"), F.floor(F.col("n") / 7)).alias("root"), "event_id")
    events = t.event.select("event_id").unionByName(leaves.select(F.col("root").alias("event_id")).distinct())
    return roles.entity_text(events, t.event_role.filter("event_type <> 'signup'"), t.role, leaves)


_WORDS = "select event_id, pos, r.role_id||coalesce(' '||array_to_string([name]||aliases,' '),'') as words from event_role r left join role using (role_id)"


@query("entity_text_blocks", with_ctes("""
    select e.event_id, coalesce(x.block_no, 0) as block_no, coalesce(x.t, e.event_id) as entity_text
    from (select event_id from event union all select distinct 'ABS-'||(n//7) from event) e
    left join (select event_id, block_no, string_agg(words, ' ' order by via, pos) as t from (
        select *, ((sum(length(words)+1) over (partition by event_id order by via, pos))::bigint - length(words) - 1)//100 as block_no from (
          select event_id, '' as via, pos, words from words where event_id in (select event_id from event where event_type<>'signup')
          union all select 'ABS-'||(n//7), event_id, pos, words from words join (select event_id, n from event where event_type<>'signup') using (event_id)))
      group by event_id, block_no) x using (event_id)""", "event_role", "role", words=_WORDS))
def entity_text_blocks(t):
    leaves = t.event.select(F.concat(F.lit("ABS-"), F.floor(F.col("n") / 7)).alias("root"), "event_id")
    events = t.event.select("event_id").unionByName(leaves.select(F.col("root").alias("event_id")).distinct())
    out = roles.entity_blocks(events, t.event_role.filter("event_type <> 'signup'"), t.role, leaves, block_chars=100)
    return out.withColumn("block_no", F.col("block_no").cast("bigint"))


# -- split chains ------------------------------------------------------------------
_CHAIN_EDGE = "select 'DOC-'||doc_id as event_id, 'DOC-'||(doc_id-1) as prefix_id from documents where doc_id%4<>0"
_CHAIN = """select e1.event_id as root, e1.prefix_id, 1 as depth from ce e1 join vis v1 on v1.event_id=e1.prefix_id
  union all select e1.event_id, e2.prefix_id, 2 from ce e1 join vis v1 on v1.event_id=e1.prefix_id join ce e2 on e2.event_id=e1.prefix_id join vis v2 on v2.event_id=e2.prefix_id
  union all select e1.event_id, e3.prefix_id, 3 from ce e1 join vis v1 on v1.event_id=e1.prefix_id join ce e2 on e2.event_id=e1.prefix_id join vis v2 on v2.event_id=e2.prefix_id
    join ce e3 on e3.event_id=e2.prefix_id join vis v3 on v3.event_id=e3.prefix_id"""
_VIS = "select 'DOC-'||doc_id as event_id from documents where doc_id%13<>0"


def chain_edges(t):
    return t.raw("documents").filter("doc_id % 4 <> 0").select(
        F.concat(F.lit("DOC-"), "doc_id").alias("event_id"), F.concat(F.lit("DOC-"), F.col("doc_id") - 1).alias("prefix_id"), F.lit(0).alias("pos"))


def chains(t):
    docs = t.raw("documents").select(F.concat(F.lit("DOC-"), "doc_id").alias("event_id"), "doc_id")
    return graph.prefix_chain(chain_edges(t), docs.filter("doc_id % 13 <> 0"), docs)


@query("prefix_chain", with_ctes("select root, prefix_id, depth, row_number() over (partition by root order by depth desc)::int as place from chain",
                                 ce=_CHAIN_EDGE, vis=_VIS, chain=_CHAIN))
def prefix_chain(t):
    w = Window.partitionBy("root").orderBy("path")
    return chains(t).select("root", "prefix_id", "depth", F.row_number().over(w).alias("place"))


@query("prefix_expand", with_ctes("""
    select query_id, event_id, out_position, is_anchor, round(score,6) as score, case when gain>0 and over-before>0 then md5(short) else md5(text) end as text_md5 from (
      select *, coalesce(sum(gain) over (partition by query_id order by position, k rows between unbounded preceding and 1 preceding),0) as before from (
        select *, sum(length(text)) over (partition by query_id) - 20000 as over,
          row_number() over (partition by query_id order by position, k)::int as out_position,
          case when not is_anchor and length(short)<length(text) then length(text)-length(short) else 0 end as gain
        from (select *, '['||event_id||'] '||left(text,40)||'…' as short from (
          select r.query_id, r.event_id, min((position, k))[1] as position, min((position, k))[2] as k, bool_or(anchor) as is_anchor,
            coalesce(max(case when anchor then score end), arg_min(score, (position, k))) as score,
            coalesce(max(case when anchor then text end), arg_min(text, (position, k))) as text
          from (select query_id, event_id, position, 9 as k, true as anchor, score, text from block
            union all select b.query_id, c.prefix_id, b.position, 3-c.depth, false, b.score*0.9::double, d.text
              from block b join chain c on c.root=b.event_id join documents d on 'DOC-'||d.doc_id=c.prefix_id) r
          group by r.query_id, r.event_id)))) """, "hits", ce=_CHAIN_EDGE, vis=_VIS, chain=_CHAIN,
    block="""select query_id, 'DOC-'||doc_id as event_id, position, 1/(60+position)::double as score, d.text from (
        select query_id, min(position) as position, doc from (select query_id, row_number() over (partition by query_id order by distance, event_id) as position,
          substr(event_id,5)::bigint % (select count(*) from documents) as doc from hits) where position<=60 group by query_id, doc) b
      join documents d on d.doc_id=b.doc"""))
def prefix_expand(t):
    w = Window.partitionBy("query_id").orderBy("distance", "event_id")
    docs = t.raw("documents")
    block = (
        t.hits.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= CFG.n_results)
        .withColumn("doc_id", F.substr("event_id", F.lit(5)).cast("long") % scalar(docs, F.count("*")))
        .groupBy("query_id", "doc_id").agg(F.min("position").alias("position")).join(docs.select("doc_id", F.length("text").alias("chars")), "doc_id")
        .select("query_id", F.concat(F.lit("DOC-"), "doc_id").alias("event_id"), "position", (1 / (60 + F.col("position"))).alias("score"), "chars"))
    texts = docs.select(F.concat(F.lit("DOC-"), "doc_id").alias("event_id"), "text")
    sizes = texts.select(F.col("event_id").alias("prefix_id"), F.length("text").alias("chars"))
    out = recall.prefix_expand(block, chains(t).join(sizes, "prefix_id"), CFG.redline, texts=texts)
    return out.select("query_id", "event_id", "out_position", "is_anchor", r6("score", "score"), F.md5("text").alias("text_md5"))


@query("split_successor_link", with_ctes("""
    select event_id, string_agg(succ, '|' order by age, pos) as successors from (
      select event_id, succ, min((age, pos))[1] as age, min((age, pos))[2] as pos from (
        select 'DOC-'||doc_id as event_id, 'OLD-'||doc_id as succ, 0 as age, '0' as pos from documents where doc_id%6=0
        union all select 'DOC-'||doc_id, 'DOC-'||(doc_id+1), 0, '1' from documents where doc_id%6=0
        union all select prefix_id, event_id, 1, event_id from ce) group by event_id, succ) group by event_id""", ce=_CHAIN_EDGE))
def split_successor_link(t):
    d = F.col("doc_id")
    known = t.raw("documents").filter("doc_id % 6 = 0").select(F.concat(F.lit("DOC-"), d).alias("event_id"), F.array(
        F.concat(F.lit("OLD-"), d), F.concat(F.lit("DOC-"), d + 1)).alias("successors"))
    return graph.split_successor_link(chain_edges(t), known).select("event_id", F.array_join("successors", "|").alias("successors"))


@query("split_successor_blocks", with_ctes("""
    select event_id, (rn-1)//2 as block_no, string_agg(succ, '|' order by rn) as successors from (
      select event_id, succ, row_number() over (partition by event_id order by age, pos, succ) as rn from (
        select event_id, succ, min((age, pos))[1] as age, min((age, pos))[2] as pos from (
          select 'DOC-'||doc_id as event_id, 'OLD-'||doc_id as succ, 0 as age, '0' as pos from documents where doc_id%6=0
          union all select 'DOC-'||doc_id, 'DOC-'||(doc_id+1), 0, '1' from documents where doc_id%6=0
          union all select 'DOC-'||doc_id, 'TOP-'||doc_id, 0, '2' from documents where doc_id%6=0
          union all select prefix_id, event_id, 1, event_id from ce) group by event_id, succ)) group by event_id, block_no""", ce=_CHAIN_EDGE))
def split_successor_blocks(t):
    d = F.col("doc_id")
    known = t.raw("documents").filter("doc_id % 6 = 0").select(F.concat(F.lit("DOC-"), d).alias("event_id"), F.array(
        F.concat(F.lit("OLD-"), d), F.concat(F.lit("DOC-"), d + 1), F.concat(F.lit("TOP-"), d)).alias("successors"))
    return graph.successor_blocks(chain_edges(t), known, block=2).select(
        "event_id", F.col("block_no").cast("bigint").alias("block_no"), F.array_join("successors", "|").alias("successors"))


@query("split_prefix_inherit", with_ctes("""
    select c.fragment_id, md5(concat_ws(chr(10), nullif(u.content,''), c.content)) as content_md5,
      case when u.doc_id%4=0 then 'EVT-'||u.doc_id else '' end as prefixes
    from (select * from fragment where kind='tail') c left join (select * from fragment where kind='prefix') u on u.doc_id=c.doc_id-1""", "fragment"))
def split_prefix_inherit(t):
    f = t.fragment
    unclosed = f.filter("kind = 'prefix'").select(
        F.col("fragment_id").alias("unclosed_id"), F.col("content").alias("open_text"),
        F.when(F.col("doc_id") % 4 == 0, F.array(F.concat(F.lit("EVT-"), "doc_id"))).otherwise(F.array().cast("array<string>")).alias("split_prefix_event_ids"))
    closing = f.filter("kind = 'tail'").select("fragment_id", "content", F.concat(F.lit("FRG-"), F.col("doc_id") - 1).alias("continuation_of"))
    out = graph.split_prefix_inherit(unclosed, closing)
    return out.select("fragment_id", F.md5("content_raw").alias("content_md5"), F.array_join("split_prefix_event_ids", "|").alias("prefixes"))


@query("orphan_split_pairs", with_ctes("""
    select split_id, case when bool_or(kind='prefix') then 'prefix' else 'tail' end as side from fragment where split_id is not null
    group by split_id having bool_or(kind='prefix') <> bool_or(kind='tail')""", "fragment"))
def orphan_split_pairs(t):
    return graph.orphan_split_pairs(t.fragment)


# -- keyed changes -------------------------------------------------------------------
@query("status_update", with_ctes("""
    select event_id, case when value>=300 then 'silent' else status end as status,
      case when value>=300 then true else is_abstracted end as is_abstracted, is_tombstoned from event""", "event"))
def status_update(t):
    change = t.event.filter("value >= 300").select("event_id", F.lit("silent").alias("status"), F.lit(True).alias("is_abstracted"))
    unknown = t.event.select(F.concat(F.lit("X"), "event_id").alias("event_id"), F.lit("silent").alias("status"), F.lit(True).alias("is_abstracted"))
    return lake.update_by_key(t.event, change.unionByName(unknown), ["event_id"]).select("event_id", "status", "is_abstracted", "is_tombstoned")


@query("delete_keys", with_ctes("select event_id, value from event where value<100", "event"))
def delete_keys(t):
    gone = t.event.filter("value >= 100").select("event_id")
    return lake.delete_keys(t.event, gone.unionByName(gone), ["event_id"]).select("event_id", "value")


_CORR = "select event_id, 'wrong value' as reason, case when n%2=0 then 'EVT-NEW' end as repl from event where value>=200"


@query("tombstone", with_ctes(r"""
    select event_id, case when c.event_id is not null and not e.is_tombstoned then 'silent' else e.status end as status,
      is_tombstoned or c.event_id is not null as is_tombstoned,
      case when c.event_id is not null and not e.is_tombstoned
        then coalesce(insight||chr(10),'')||'[TOMBSTONE] wrong value'||coalesce(' → replaced by '||repl,'') else insight end as insight
    from event e left join corr c using (event_id)""".replace("c.event_id", "c.reason"), "event", corr=_CORR))
def tombstone(t):
    from memlake.operators.revise import tombstone as op
    corr = t.event.filter("value >= 200").select("event_id", F.lit("wrong value").alias("reason"), F.when(F.col("n") % 2 == 0, "EVT-NEW").alias("replacement_id"))
    again = corr.withColumn("reason", F.lit("zz repeated"))
    return op(t.event, corr.unionByName(again)).select("event_id", "status", "is_tombstoned", "insight")


@query("revive", with_ctes("""
    select event_id, case when n%2=0 then 'active' else status end as status, is_tombstoned and n%2<>0 as is_tombstoned, insight from event""", "event"))
def revive(t):
    from memlake.operators.revise import revive as op
    return op(t.event, t.event.filter("n % 2 = 0").select("event_id")).select("event_id", "status", "is_tombstoned", "insight")

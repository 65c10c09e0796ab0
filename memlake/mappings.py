"""Memory tables derived from the given tables, once as DataFrames and once as SQL.

`Tables` gives every mapping as a lazy DataFrame; `CTE` holds the same rule as a
named SQL expression, and `with_ctes` puts the needed ones in front of a query.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from memlake.config import DEFAULT, EMOTIONS, MemoryConfig
from memlake.functions import affect, ids, scoring

EPOCH = "2024-01-01 00:00:00"


def scalar(df: DataFrame, agg: Column) -> Column:
    """A one-value aggregate of a whole table as a scalar subquery."""
    return df.agg(agg.alias("v")).scalar()


class Tables:
    def __init__(self, spark: SparkSession, path: str, cfg: MemoryConfig = DEFAULT):
        self.spark, self.path, self.cfg = spark, path.rstrip("/"), cfg
        self._raw: dict[str, DataFrame] = {}

    def raw(self, name: str) -> DataFrame:
        if name not in self._raw:
            self._raw[name] = self.spark.read.parquet(f"{self.path}/{name}.parquet")
        return self._raw[name]

    # -- events -----------------------------------------------------------
    @cached_property
    def event(self) -> DataFrame:
        """Basic events without their text."""
        n = F.col("event_id")
        return self.raw("events").select(
            F.concat(F.lit("EVT-"), F.lpad(n.cast("string"), 12, "0")).alias("event_id"),
            n.alias("n"), F.col("ts").alias("create_time"), "user_id", "event_type", "value",
            F.get_json_object("props", "$.k").cast("int").alias("k"),
            F.lit(False).alias("is_abstract"), (n % 5 == 0).alias("is_abstracted"),
            (n % 97 == 0).alias("is_tombstoned"),
            F.when((F.col("event_type") == "error") & (F.col("value") < 1), "silent")
            .otherwise("active").alias("status"),
            F.when(n % 11 == 0, 1.5).when(n % 7 == 0, 0.5).otherwise(0.0).alias("abstract_coverage"),
            F.when(n % 13 == 0, "old note").alias("insight"),
        )

    def with_text(self, events: DataFrame) -> DataFrame:
        """Events (`n` and any other columns) with raw text and summaries L1..L4 taken from documents; joined last, texts are not shuffled once an event."""
        docs = self.raw("documents").select("doc_id", F.col("text").alias("content_raw"))
        return self._with_summaries(self._of_document(events, docs))

    def _with_summaries(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("summaries", F.create_map(
            *[x for k in range(1, 5) for x in (F.lit(f"L{k}"), self._level(F.col("content_raw"), k))]))

    def with_sizes(self, events: DataFrame) -> DataFrame:
        """Events with the characters of their raw text and of L1..L4 (`sizes`), measured before they join."""
        text = F.col("text")
        sizes = F.array(F.length(text), *[F.length(self._level(text, k)) for k in range(1, 5)])
        return self._of_document(events, self.raw("documents").select("doc_id", sizes.alias("sizes")))

    def _of_document(self, events: DataFrame, docs: DataFrame) -> DataFrame:
        return events.withColumn("doc_id", F.col("n") % scalar(self.raw("documents"), F.count("*"))).join(docs, "doc_id")

    @staticmethod
    def _level(text: Column, k: int) -> Column:
        return F.substr(text, F.lit(1), F.greatest(F.lit(35), F.floor(F.length(text) / (2 ** k)).cast("int")))

    @cached_property
    def event_text(self) -> DataFrame:
        """Basic events with raw text and summaries."""
        return self.with_text(self.event)

    @cached_property
    def event_sized(self) -> DataFrame:
        """Basic events with the lengths of their texts (`names`, `sizes`, `raw_size`) and the key of `texts`; lengths are measured before they join."""
        text = F.col("text")
        levels = F.array(*[F.length(self._level(text, k)) for k in range(1, 5)])
        docs = self.raw("documents").select("doc_id", F.length(text).alias("raw_size"), levels.alias("sizes"), F.xxhash64(text).alias("text_digest"))
        names = F.array(*[F.lit(f"L{k}") for k in range(1, 5)])
        return self._of_document(self.event, docs).withColumn("names", names).withColumnRenamed("doc_id", "text_id")

    @cached_property
    def texts(self) -> DataFrame:
        """Raw text and summaries by the key that `event_sized` gives, each key once."""
        text = F.col("text")
        docs = self.raw("documents").select(F.col("doc_id").alias("text_id"), F.xxhash64(text).alias("text_digest"), text.alias("content_raw"))
        return self._with_summaries(docs.dropDuplicates(["text_id", "text_digest"]))

    @cached_property
    def as_of(self) -> Column:
        """The newest event time, found once and put into plans as a value."""
        return F.lit(self.raw("events").agg(F.max("ts")).first()[0]).cast("timestamp_ntz")

    @cached_property
    def event_role(self) -> DataFrame:
        """Two roles per event; the second one rank lower with half the emotion."""
        x = F.least(F.col("value") / 100, F.lit(1.0))
        kind = lambda name: F.col("event_type") == name
        emo = {
            "anger": F.when(kind("error"), x), "fear": F.when(kind("error"), x / 2),
            "joy": F.when(kind("purchase"), x).when(kind("click"), x / 4),
            "trust": F.when(kind("purchase"), x / 2).when(kind("signup"), x),
            "anticipation": F.when(kind("signup"), x / 2).when(kind("view"), x / 3),
            "surprise": F.when(kind("click"), x), "sadness": F.when(kind("view"), x / 2),
            "disgust": F.lit(0.0),
        }
        v = F.col("value")
        band = F.when(v >= 200, 5).when(v >= 100, 4).when(v >= 50, 3).when(v >= 10, 2).otherwise(1)
        name = lambda rank: F.substr(F.lit("DCBAS"), rank, F.lit(1))
        base = self.event.withColumns({e: F.coalesce(c, F.lit(0.0)) for e, c in emo.items()}).withColumn("band", band)
        sides = F.array(
            F.struct(F.lit(1).alias("pos"), F.concat(F.lit("ROL-U"), "user_id").alias("role_id"),
                     F.col("band").alias("rank"), F.lit(1.0).alias("share")),
            F.struct(F.lit(2).alias("pos"), F.concat(F.lit("ROL-K"), "k").alias("role_id"),
                     F.greatest(F.col("band") - 1, F.lit(1)).alias("rank"), F.lit(0.5).alias("share")))
        rows = base.withColumn("s", F.explode(sides)).select(
            "event_id", "n", "create_time", "event_type", "k", "s.pos", "s.role_id", "s.rank",
            *[(F.col(e) * F.col("s.share")).alias(e) for e in EMOTIONS])
        return rows.withColumns({
            "importance": name(F.col("rank")),
            "arousal": affect.arousal(F.col), "valence": affect.valence(F.col),
            "l1_mention": F.concat_ws(" ", "role_id", "event_type"),
            "l2_interaction": F.when(F.col("n") % 3 > 0, F.concat_ws(" ", "role_id", F.lit("met"), "event_type", "k")),
            "l3_decision": F.when(F.col("n") % 2 == 0, F.concat_ws(" ", "role_id", F.lit("decided on"), "event_type", "k")),
        })

    @cached_property
    def timeline(self) -> DataFrame:
        from memlake.operators.timeline import timeline_update
        return timeline_update(self.event_role, self.cfg).withColumn(
            "last_accessed_time", F.col("create_time") + F.make_dt_interval((F.col("n") % 7).cast("int")))

    # -- roles ------------------------------------------------------------
    @cached_property
    def role(self) -> DataFrame:
        """Customers as people, nation names as aliases of the first ones, key roles beside them."""
        nation = self.raw("nation").select(F.col("n_nationkey").cast("long").alias("c_custkey"), "n_name")
        people = self.raw("customer").join(nation, "c_custkey", "left").select(
            F.concat(F.lit("ROL-U"), "c_custkey").alias("role_id"), F.col("c_name").alias("name"),
            F.lit("person").alias("entity_type"),
            F.when(F.col("n_name").isNull(), F.array().cast("array<string>"))
            .otherwise(F.array("n_name")).alias("aliases"))
        keys = self.event.select("k").distinct().select(
            F.concat(F.lit("ROL-K"), "k").alias("role_id"), F.concat(F.lit("KEY_"), "k").alias("name"),
            F.lit("topic").alias("entity_type"), F.array().cast("array<string>").alias("aliases"))
        return people.unionByName(keys)

    # -- queries and hits -------------------------------------------------
    @cached_property
    def hits(self) -> DataFrame:
        """Each user is a query, the user's events are its hits over three routes."""
        n = F.col("n")
        return self.event.select(
            F.concat(F.lit("Q-"), "user_id").alias("query_id"), "event_id", (F.col("k") % 3).alias("route"),
            (F.col("value") / 500).alias("distance"), F.col("k").cast("double").alias("weight"),
            F.when(n % 4 == 0, -0.5).when(n % 4 == 1, 0.8).otherwise(0.0).alias("event_valence"),
            F.when(F.col("user_id") % 2 == 0, 0.6).otherwise(-0.4).alias("query_valence"),
            "abstract_coverage", "create_time",
            (F.lit(40) + (n * 37) % 900).cast("int").alias("text_len"))

    # -- recall log -------------------------------------------------------
    @cached_property
    def recall_log(self) -> DataFrame:
        """One transaction per user and week."""
        week = F.floor((scoring.micros(F.col("create_time")) - F.unix_micros(F.lit(EPOCH).cast("timestamp")))
                       / F.lit(7 * scoring.DAY_US)).cast("int")
        item = F.concat_ws("-", "event_type", F.floor(F.col("k") / 50).cast("string"))
        return (
            self.event.select("user_id", week.alias("week"), item.alias("item")).distinct()
            .groupBy("user_id", "week").agg(F.array_sort(F.collect_list("item")).alias("event_ids"))
            .select(F.concat(F.lit("RCL-"), "user_id", F.lit("-"), "week").alias("recall_id"),
                    (F.lit(EPOCH).cast("timestamp_ntz") + F.make_dt_interval(F.col("week") * 7)).alias("created_at"),
                    "event_ids"))

    # -- graphs -----------------------------------------------------------
    @cached_property
    def graph_node(self) -> DataFrame:
        """Regions and nations as abstract events, customers as leaves."""
        at = lambda s: F.lit(EPOCH).cast("timestamp_ntz") + F.make_dt_interval(secs=s)
        cust = self.raw("customer").select(
            F.concat(F.lit("CUS-"), "c_custkey").alias("event_id"), F.lit(False).alias("is_abstract"),
            F.lit(0).alias("level"), at((F.col("c_custkey") % 86400).cast("int")).alias("create_time"),
            F.col("c_name").alias("content_raw"), (F.col("c_custkey") % 13 == 0).alias("is_tombstoned"),
            (F.col("c_custkey") % 17 == 0).alias("ptsd_immune"), F.col("c_custkey").alias("key"))
        nat = self.raw("nation").select(
            F.concat(F.lit("NAT-"), "n_nationkey").alias("event_id"), F.lit(True).alias("is_abstract"),
            F.lit(1).alias("level"), at(F.lit(100000) + F.col("n_nationkey")).alias("create_time"),
            F.col("n_name").alias("content_raw"), (F.col("n_nationkey") == 7).alias("is_tombstoned"),
            F.lit(False).alias("ptsd_immune"), F.col("n_nationkey").cast("long").alias("key"))
        reg = self.raw("region").select(
            F.concat(F.lit("REG-"), "r_regionkey").alias("event_id"), F.lit(True).alias("is_abstract"),
            F.lit(2).alias("level"), at(F.lit(200000) + F.col("r_regionkey")).alias("create_time"),
            F.col("r_name").alias("content_raw"), F.lit(False).alias("is_tombstoned"),
            F.lit(False).alias("ptsd_immune"), F.col("r_regionkey").cast("long").alias("key"))
        return cust.unionByName(nat).unionByName(reg)

    @cached_property
    def graph_edge(self) -> DataFrame:
        low = self.raw("customer").select(
            F.concat(F.lit("NAT-"), "c_nationkey").alias("parent"), F.concat(F.lit("CUS-"), "c_custkey").alias("child"))
        top = self.raw("nation").select(
            F.concat(F.lit("REG-"), "n_regionkey").alias("parent"), F.concat(F.lit("NAT-"), "n_nationkey").alias("child"))
        return low.unionByName(top)

    @cached_property
    def basket_edge(self) -> DataFrame:
        """Orders as abstract events over the parts they contain, laid out by order: joins on it move the edges no second time."""
        return self.raw("lineitem").select(
            F.concat(F.lit("ORD-"), "l_orderkey").alias("parent"),
            F.concat(F.lit("PRT-"), "l_partkey").alias("child")).repartition("parent").distinct()

    # -- vectors ----------------------------------------------------------
    @cached_property
    def vector(self) -> DataFrame:
        e = F.col("embedding")
        return self.raw("embeddings").select(
            F.concat(F.lit("VEC-"), "vec_id").alias("event_id"), "vec_id", "label", "embedding",
            F.slice(e, 1, 32).alias("act"), F.slice(e, 33, 16).alias("emo"), F.slice(e, 49, 16).alias("ent"))

    @cached_property
    def vector_query(self) -> DataFrame:
        """One query per label: the mean of the label's vectors."""
        mean = F.array(*[F.avg(F.col("embedding")[i].cast("double")) for i in range(64)])
        q = self.raw("embeddings").groupBy("label").agg(mean.alias("embedding"))
        e = F.col("embedding")
        return q.select(F.concat(F.lit("Q-"), "label").alias("query_id"), "label", "embedding",
                        F.slice(e, 1, 32).alias("act"), F.slice(e, 33, 16).alias("emo"),
                        F.slice(e, 49, 16).alias("ent"))

    # -- turns ------------------------------------------------------------
    @cached_property
    def turn(self) -> DataFrame:
        """Conversation turns with an event time: one per ten minutes, a long pause before every fifth."""
        t = F.col("turn")
        minutes = (F.col("conv_id") % 1000) * 7 + t * 10 + F.floor(t / 5) * 90
        return self.raw("conversations").select(
            "conv_id", "turn", "role", "text",
            F.concat_ws("-", F.lit("TRN"), "conv_id", "turn").alias("turn_id"),
            (F.lit(EPOCH).cast("timestamp_ntz") + F.make_dt_interval(mins=minutes.cast("int"))).alias("ts"))

    @cached_property
    def fragment(self) -> DataFrame:
        """Documents as open fragments with planted split ids and lengths."""
        return self.raw("documents").select(
            F.concat(F.lit("FRG-"), "doc_id").alias("fragment_id"), "doc_id", F.col("text").alias("content"),
            F.when(F.col("doc_id") % 2 == 0, "prefix").otherwise("tail").alias("kind"),
            F.when(F.col("doc_id") % 3 < 2, F.concat(F.lit("S-"), F.floor(F.col("doc_id") / 2).cast("string"))).alias("split_id"))

    @cached_property
    def phase_sample(self) -> DataFrame:
        """Events as timing samples of the pipeline phases."""
        kind = lambda n: F.col("event_type") == n
        return self.event.select(
            F.when(kind("click"), "rag_search").when(kind("view"), "recall_assembly")
            .when(kind("purchase"), "abstraction_mining").when(kind("error"), "narrative_dedupe")
            .otherwise("other").alias("phase"),
            F.col("n").alias("seq"), "create_time", (F.col("value") * 2).alias("elapsed_ms"))

    @cached_property
    def invocation(self) -> DataFrame:
        """Events as model calls."""
        return self.event.select(
            F.col("event_type").alias("task_type"), F.concat(F.lit("model-"), F.col("k") % 4).alias("model"),
            F.col("value").alias("latency_ms"), (F.col("n") % 500).alias("prompt_tokens"),
            (F.col("k") * 3).alias("completion_tokens"), "n", "create_time")


# -- the same rules as SQL ------------------------------------------------
_EMO = {
    "anger": "case when event_type='error' then x else 0 end",
    "fear": "case when event_type='error' then x/2 else 0 end",
    "joy": "case when event_type='purchase' then x when event_type='click' then x/4 else 0 end",
    "sadness": "case when event_type='view' then x/2 else 0 end",
    "surprise": "case when event_type='click' then x else 0 end",
    "disgust": "0.0::double",
    "trust": "case when event_type='purchase' then x/2 when event_type='signup' then x else 0 end",
    "anticipation": "case when event_type='signup' then x/2 when event_type='view' then x/3 else 0 end",
}
_AROUSAL = "greatest(" + ",".join(e for e in EMOTIONS if e != "trust") + ")"
_VALENCE = ("((joy+trust)-(anger+fear+sadness+disgust))"
            "/((joy+trust)+(anger+fear+sadness+disgust)+1e-6)")
AGE_DAYS = "greatest((epoch_us({b})-epoch_us({a}))/86400e6, 0.0)"

CTE: dict[str, tuple[tuple[str, ...], str]] = {
    "event": ((), """
        select 'EVT-'||lpad(event_id::varchar,12,'0') as event_id, event_id as n, ts as create_time, user_id,
          event_type, value, cast(json_extract_string(props,'$.k') as int) as k, false as is_abstract,
          event_id%5=0 as is_abstracted, event_id%97=0 as is_tombstoned,
          case when event_type='error' and value<1 then 'silent' else 'active' end as status,
          (case when event_id%11=0 then 1.5 when event_id%7=0 then 0.5 else 0.0 end)::double as abstract_coverage,
          case when event_id%13=0 then 'old note' end as insight
        from events"""),
    "event_text": (("event",), """
        select e.*, d.text as content_raw,
          left(d.text, greatest(35, length(d.text)//2)) as s1, left(d.text, greatest(35, length(d.text)//4)) as s2,
          left(d.text, greatest(35, length(d.text)//8)) as s3, left(d.text, greatest(35, length(d.text)//16)) as s4
        from event e join documents d on d.doc_id = e.n % (select count(*) from documents)"""),
    "clock": ((), "select max(ts) as t from events"),
    "event_role": (("event",), f"""
        select event_id, n, create_time, event_type, k, pos, role_id, rank,
          {",".join(EMOTIONS)}, substr('DCBAS', rank, 1) as importance,
          {_AROUSAL} as arousal, {_VALENCE} as valence,
          role_id||' '||event_type as l1_mention,
          case when n%3>0 then role_id||' met '||event_type||' '||k end as l2_interaction,
          case when n%2=0 then role_id||' decided on '||event_type||' '||k end as l3_decision
        from (
          select event_id, n, create_time, event_type, k, p.pos,
            case when p.pos=1 then 'ROL-U'||user_id else 'ROL-K'||k end as role_id,
            case when p.pos=1 then band else greatest(band-1,1) end as rank,
            {",".join(f"({q})*(case when p.pos=1 then 1.0 else 0.5 end)::double as {e}" for e, q in _EMO.items())}
          from (select *, least(value/100, 1.0)::double as x,
                  case when value>=200 then 5 when value>=100 then 4 when value>=50 then 3
                       when value>=10 then 2 else 1 end as band from event)
          cross join (values (1),(2)) p(pos))"""),
    "timeline": (("event_role",), """
        select role_id, event_id, n, create_time, importance, arousal, valence,
          case when importance in ('S','A') then coalesce(l3_decision, l2_interaction, l1_mention)
               else coalesce(l2_interaction, l1_mention, l3_decision) end as role_summary,
          least(greatest(arousal,0),1) as memory_weight,
          100.0*pow(least(greatest(arousal,0),1),2.0) as forgetting_factor,
          100.0*pow(least(greatest(arousal,0),1),2.0) as base_forgetting_factor,
          create_time + to_days((n%7)::int) as last_accessed_time
        from event_role"""),
    "role": (("event",), """
        select 'ROL-U'||c_custkey as role_id, c_name as name, 'person' as entity_type,
          case when n_name is null then []::varchar[] else [n_name] end as aliases
        from customer left join nation on n_nationkey=c_custkey
        union all select distinct 'ROL-K'||k, 'KEY_'||k, 'topic', []::varchar[] from event"""),
    "hits": (("event",), """
        select 'Q-'||user_id as query_id, event_id, k%3 as route, value/500 as distance, k::double as weight,
          (case when n%4=0 then -0.5 when n%4=1 then 0.8 else 0.0 end)::double as event_valence,
          (case when user_id%2=0 then 0.6 else -0.4 end)::double as query_valence,
          abstract_coverage, create_time, (40+(n*37)%900)::int as text_len
        from event"""),
    "recall_log": (("event",), f"""
        select 'RCL-'||user_id||'-'||week as recall_id, timestamp '{EPOCH}' + to_days((week*7)::int) as created_at,
          list_sort(list(item)) as event_ids
        from (select distinct user_id, ((epoch_us(create_time)-epoch_us(timestamp '{EPOCH}'))//(7*86400000000))::int as week,
                event_type||'-'||(k//50) as item from event)
        group by user_id, week"""),
    "graph_node": ((), f"""
        select 'CUS-'||c_custkey as event_id, false as is_abstract, 0 as level,
          timestamp '{EPOCH}' + to_seconds(c_custkey%86400) as create_time, c_name as content_raw,
          c_custkey%13=0 as is_tombstoned, c_custkey%17=0 as ptsd_immune, c_custkey as key from customer
        union all select 'NAT-'||n_nationkey, true, 1, timestamp '{EPOCH}' + to_seconds(100000+n_nationkey), n_name,
          n_nationkey=7, false, n_nationkey from nation
        union all select 'REG-'||r_regionkey, true, 2, timestamp '{EPOCH}' + to_seconds(200000+r_regionkey), r_name,
          false, false, r_regionkey from region"""),
    "graph_edge": ((), """
        select 'NAT-'||c_nationkey as parent, 'CUS-'||c_custkey as child from customer
        union all select 'REG-'||n_regionkey, 'NAT-'||n_nationkey from nation"""),
    "graph_leaf": (("graph_node", "graph_edge"), """
        select distinct root, event_id from (
          select a.event_id as root, l.event_id from graph_node a join graph_edge x on x.parent=a.event_id
            join graph_node l on l.event_id=x.child where not a.is_tombstoned and not l.is_tombstoned and not l.is_abstract
          union all
          select a.event_id, l.event_id from graph_node a join graph_edge x on x.parent=a.event_id
            join graph_node m on m.event_id=x.child join graph_edge y on y.parent=m.event_id
            join graph_node l on l.event_id=y.child
          where not a.is_tombstoned and m.is_abstract and not m.is_tombstoned and not l.is_tombstoned and not l.is_abstract)"""),
    "basket_edge": ((), """
        select distinct 'ORD-'||l_orderkey as parent, 'PRT-'||l_partkey as child from lineitem"""),
    "vector": ((), """
        select 'VEC-'||vec_id as event_id, vec_id, label, embedding::double[] as embedding,
          embedding[1:32]::double[] as act, embedding[33:48]::double[] as emo, embedding[49:64]::double[] as ent
        from embeddings"""),
    "vector_query": ((), f"""
        select 'Q-'||label as query_id, label, embedding, embedding[1:32] as act, embedding[33:48] as emo,
          embedding[49:64] as ent
        from (select label, [{",".join(f"avg(embedding[{i}]::double)" for i in range(1, 65))}] as embedding
              from embeddings group by label)"""),
    "turns": ((), f"""
        select conv_id, turn, role, text, 'TRN-'||conv_id||'-'||turn as turn_id,
          timestamp '{EPOCH}' + to_minutes((conv_id%1000)*7 + turn*10 + (turn//5)*90) as ts
        from conversations"""),
    "fragment": ((), """
        select 'FRG-'||doc_id as fragment_id, doc_id, text as content,
          case when doc_id%2=0 then 'prefix' else 'tail' end as kind,
          case when doc_id%3<2 then 'S-'||(doc_id//2) end as split_id from documents"""),
    "phase_sample": (("event",), """
        select case event_type when 'click' then 'rag_search' when 'view' then 'recall_assembly'
            when 'purchase' then 'abstraction_mining' when 'error' then 'narrative_dedupe' else 'other' end as phase,
          n as seq, create_time, value*2 as elapsed_ms from event"""),
    "invocation": (("event",), """
        select event_type as task_type, 'model-'||(k%4) as model, value as latency_ms, n%500 as prompt_tokens,
          k*3 as completion_tokens, n, create_time from event"""),
}


def with_ctes(body: str, *names: str, **extra: str) -> str:
    """Put the named mappings and any extra ones in front of a query."""
    done: dict[str, str] = {}

    def need(name: str) -> None:
        if name in done:
            return
        deps, sql = CTE[name]
        for d in deps:
            need(d)
        done[name] = sql

    for n in names:
        need(n)
    done.update(extra)
    parts = ",\n".join(f"{k} as ({v})" for k, v in done.items())
    return f"with {parts}\n{body}" if parts else body

"""Views that map the generated tables onto the engine's data model.

Each view exists twice with the same content: as a DataFrame (``Tables``) and
as SQL text (``VIEWS``) for the comparison queries.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from anamnesis.operators.links import both_ways, build_links
from anamnesis.session import materialize, prepare

AS_OF = "2024-02-01 00:00:00"
BANKS = 5
BATCH = 25
# the generated vectors are nearly orthogonal: no pair reaches the default thresholds
LINK_THRESHOLD = 0.25


def as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp")


class Tables:
    """The generated tables below one folder and the views over them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = prepare(spark)
        self.sf_dir = sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def events(self) -> DataFrame:
        return self.read("events").withColumn("ts", F.col("ts").cast("timestamp"))

    @cached_property
    def units(self) -> DataFrame:
        """One unit per document; every event belongs to one unit, whose time is its latest event's."""
        docs, events, vectors = self.read("documents"), self.events, self.read("embeddings")
        n_docs, n_events, n_vectors = (df.agg(F.count("*")).scalar() for df in (docs, events, vectors))
        i, ts = F.col("unit_id"), F.col("ts")
        slots = F.least(n_docs, n_events)
        latest = events.groupBy((F.col("event_id") % slots).alias("slot")).agg(
            F.max_by("ts", "event_id").alias("ts"), F.max_by("event_type", "event_id").alias("event_type")
        )
        return (
            docs.select(F.col("doc_id").alias("unit_id"), "text", "source")
            .withColumns({"vec_id": i % n_vectors, "slot": i % slots})
            .join(vectors.select("vec_id", "embedding", "label"), "vec_id")
            .join(latest, "slot")
            .select(
                "unit_id",
                (i % BANKS).alias("bank_id"),
                F.floor(i / BATCH).cast("bigint").alias("batch_id"),
                "text",
                F.col("source").alias("context"),
                "embedding",
                F.when(F.col("label") <= 3, "world")
                .when(F.col("label") <= 6, "experience")
                .otherwise("observation")
                .alias("fact_type"),
                F.when(i % 4 == 0, "conversation").otherwise("event").alias("fact_kind"),
                F.when(i % 4 != 0, ts).alias("event_date"),
                F.when(i % 3 == 0, ts).alias("occurred_start"),
                F.when(i % 6 == 0, ts + F.expr("interval 36 hours")).alias("occurred_end"),
                (ts + F.expr("interval 30 minutes")).alias("mentioned_at"),
                (ts + F.expr("interval 1 hour")).alias("created_at"),
                F.col("event_type").alias("tag"),
            )
        )

    @cached_property
    def entities(self) -> DataFrame:
        banks = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(BANKS - 1).cast("bigint")))
        return (
            self.read("supplier")
            .select("s_suppkey", "s_name", "s_acctbal", banks.alias("bank_id"))
            .select(
                (F.col("s_suppkey") * BANKS + F.col("bank_id")).alias("entity_id"),
                "bank_id",
                F.col("s_name").alias("canonical_name"),
                F.col("s_acctbal").alias("balance"),
            )
        )

    @cached_property
    def unit_entities(self) -> DataFrame:
        """Every order names the supplier of its dearest line to one unit."""
        dearest = F.struct(-F.col("l_extendedprice"), "l_linenumber", "l_suppkey")
        unit = F.col("l_orderkey") % self.read("documents").agg(F.count("*")).scalar()
        return (
            self.read("lineitem")
            .groupBy("l_orderkey")
            .agg(F.min_by("l_suppkey", dearest).alias("supplier"))
            .select(unit.alias("unit_id"), (F.col("supplier") * BANKS + unit % BANKS).alias("entity_id"))
            .distinct()
        )

    @cached_property
    def obs_sources(self) -> DataFrame:
        """Observation to source: the facts among the five units of the bank before it."""
        back = F.transform(F.sequence(F.lit(1), F.lit(5)), lambda i: F.col("unit_id") - i * BANKS)
        candidates = self.units.filter(F.col("fact_type") == "observation").select(
            F.col("unit_id").alias("obs_id"), F.explode(back).alias("source_id")
        )
        facts = self.units.filter(F.col("fact_type") != "observation").select(F.col("unit_id").alias("source_id"))
        return candidates.join(facts, "source_id").select("obs_id", "source_id")

    @cached_property
    def unit_tags(self) -> DataFrame:
        tagged = self.units.filter(F.col("unit_id") % 7 != 0)
        lang = F.when(F.col("unit_id") % 2 == 0, "lang_a").otherwise("lang_b")
        return tagged.select("unit_id", F.explode(F.array("tag", lang)).alias("tag")).distinct()

    @cached_property
    def tagged_units(self) -> DataFrame:
        lang = F.when(F.col("unit_id") % 2 == 0, "lang_a").otherwise("lang_b")
        return self.units.withColumn("tags", F.when(F.col("unit_id") % 7 != 0, F.array_sort(F.array("tag", lang))))

    @cached_property
    def models(self) -> DataFrame:
        """Summaries of the entities that as many units name as name an entity on average, or more."""
        named = self.unit_entities.groupBy("entity_id").agg(F.count("*").alias("named"))
        usual = named.agg(F.avg("named")).scalar()
        n = self.read("documents").agg(F.count("*")).scalar()
        units = self.units.select("unit_id", "embedding", "created_at")
        e = F.col("entity_id")
        return (
            self.entities.join(named.filter(F.col("named") >= usual), "entity_id")
            .withColumn("unit_id", e % n)
            .join(units, "unit_id")
            .select(
                e.alias("model_id"),
                "bank_id",
                e.alias("entity_id"),
                F.col("canonical_name").alias("name"),
                "embedding",
                "created_at",
                F.when(e % 8 == 0, "q").alias("source_query"),
                (e % 3 == 0).alias("refresh_after_consolidation"),
                F.when(e % 5 != 0, F.col("created_at")).alias("last_refreshed_at"),
            )
        )

    @cached_property
    def links(self) -> DataFrame:
        """The stored link table: all built links, and causal links between neighbours of a call."""
        built = build_links(self.units, self.unit_entities, threshold=LINK_THRESHOLD)
        i = F.col("unit_id")
        cause = self.units.filter(i % BATCH < BATCH - BANKS)
        effect = self.units.select((i - BANKS).alias("unit_id"))
        forward = cause.join(effect, "unit_id").select(
            "bank_id",
            i.alias("from_unit_id"),
            (i + BANKS).alias("to_unit_id"),
            F.lit("causes").alias("link_type"),
            F.lit(0.8).alias("weight"),
            F.lit(None).cast("bigint").alias("entity_id"),
        )
        back = both_ways(forward).filter(F.col("from_unit_id") > F.col("to_unit_id")).withColumn("link_type", F.lit("caused_by"))
        return materialize(built.unionByName(forward).unionByName(back), "links")

    def _ranged(self, query_id: Column) -> list[Column]:
        start = F.date_add(F.lit("2024-01-01").cast("date"), (query_id % 25).cast("int"))
        return [
            start.cast("timestamp").alias("range_start"),
            F.date_add(start, 4).cast("timestamp").alias("range_end"),
        ]

    @cached_property
    def queries(self) -> DataFrame:
        """One question per benchmark text."""
        vectors = self.read("embeddings")
        n = vectors.agg(F.count("*")).scalar()
        return (
            self.read("benchmark")
            .withColumn("vec_id", F.col("item_id") % n)
            .join(vectors.select("vec_id", "embedding"), "vec_id")
            .select(
                F.col("item_id").alias("query_id"),
                (F.col("item_id") % BANKS).alias("bank_id"),
                "text",
                "embedding",
                *self._ranged(F.col("item_id")),
            )
        )

    @cached_property
    def probes(self) -> DataFrame:
        """One vector query per stored vector."""
        v = F.col("vec_id")
        return self.read("embeddings").select(
            v.alias("query_id"), (v % BANKS).alias("bank_id"), "embedding", *self._ranged(v)
        )

    @cached_property
    def messages(self) -> DataFrame:
        return self.read("conversations").select("conv_id", "turn", "role", F.col("text").alias("content"))

    @cached_property
    def comments(self) -> DataFrame:
        kind, user = F.col("event_type"), F.col("user_id")
        return self.events.select(
            F.col("event_id").alias("comment_id"),
            "ts",
            (user % 10).alias("channel_id"),
            user.alias("user_name"),
            F.when(kind == "error", "")
            .when(kind == "signup", F.concat(F.lit("#"), kind))
            .otherwise(F.concat(kind, F.lit(" "), user.cast("string")))
            .alias("comment"),
        )

    @cached_property
    def detections(self) -> DataFrame:
        return self.events.select(
            (F.col("user_id") % 10).alias("device_id"),
            "ts",
            F.col("event_id").alias("seq"),
            F.col("event_type").isin("click", "view", "purchase").alias("face_detected"),
        )


VIEWS = {
    "fx_units": """
select d.doc_id as unit_id, d.doc_id % 5 as bank_id, d.doc_id // 25 as batch_id, d.text as text, d.source as context,
 e.embedding as embedding,
 case when e.label <= 3 then 'world' when e.label <= 6 then 'experience' else 'observation' end as fact_type,
 case when d.doc_id % 4 = 0 then 'conversation' else 'event' end as fact_kind,
 case when d.doc_id % 4 = 0 then null else v.ts end as event_date,
 case when d.doc_id % 3 = 0 then v.ts else null end as occurred_start,
 case when d.doc_id % 6 = 0 then v.ts + interval '36' hour else null end as occurred_end,
 v.ts + interval '30' minute as mentioned_at, v.ts + interval '1' hour as created_at, v.event_type as tag
from documents d
 join embeddings e on e.vec_id = d.doc_id % (select count(*) from embeddings)
 join (select event_id % (select least((select count(*) from documents), (select count(*) from events))) as slot, arg_max(ts, event_id) as ts,
  arg_max(event_type, event_id) as event_type from events group by 1) v
  on v.slot = d.doc_id % (select least((select count(*) from documents), (select count(*) from events)))""",
    "fx_entities": """
select s.s_suppkey * 5 + b.bank_id as entity_id, b.bank_id as bank_id, s.s_name as canonical_name, s.s_acctbal as balance
from supplier s cross join (select unnest(range(5)) as bank_id) b""",
    "fx_unit_entities": """
select distinct l_orderkey % n as unit_id, l_suppkey * 5 + l_orderkey % n % 5 as entity_id from (
 select l_orderkey, l_suppkey, (select count(*) from documents) as n,
  row_number() over (partition by l_orderkey order by l_extendedprice desc, l_linenumber, l_suppkey) as rn from lineitem) where rn = 1""",
    "fx_obs_sources": """
select o.unit_id as obs_id, u.unit_id as source_id from fx_units o join fx_units u on u.bank_id = o.bank_id
 and u.unit_id between o.unit_id - 25 and o.unit_id - 1 and u.fact_type <> 'observation'
where o.fact_type = 'observation'""",
    "fx_unit_tags": """
select unit_id, tag from fx_units where unit_id % 7 <> 0
union select unit_id, 'lang_' || case when unit_id % 2 = 0 then 'a' else 'b' end from fx_units where unit_id % 7 <> 0""",
    "fx_models": """
select e.entity_id as model_id, e.bank_id as bank_id, e.entity_id as entity_id, e.canonical_name as name,
 m.embedding as embedding, m.created_at as created_at,
 case when e.entity_id % 8 = 0 then 'q' else null end as source_query, e.entity_id % 3 = 0 as refresh_after_consolidation,
 case when e.entity_id % 5 = 0 then null else m.created_at end as last_refreshed_at
from fx_entities e join fx_units m on m.unit_id = e.entity_id % (select count(*) from documents)
 join (select entity_id, count(*) as named from fx_unit_entities group by 1) x on x.entity_id = e.entity_id
where x.named >= (select count(*) / count(distinct entity_id) from fx_unit_entities)""",
    "fx_queries": """
select b.item_id as query_id, b.item_id % 5 as bank_id, b.text as text, e.embedding as embedding,
 timestamp '2024-01-01 00:00:00' + (b.item_id % 25) * interval '1' day as range_start,
 timestamp '2024-01-01 00:00:00' + (b.item_id % 25 + 4) * interval '1' day as range_end
from benchmark b cross join (select count(*) n from embeddings) nv join embeddings e on e.vec_id = b.item_id % nv.n""",
    "fx_probes": """
select vec_id as query_id, vec_id % 5 as bank_id, embedding,
 timestamp '2024-01-01 00:00:00' + (vec_id % 25) * interval '1' day as range_start,
 timestamp '2024-01-01 00:00:00' + (vec_id % 25 + 4) * interval '1' day as range_end
from embeddings""",
    "fx_messages": "select conv_id, turn, role, text as content from conversations",
    "fx_comments": """
select event_id as comment_id, ts, user_id % 10 as channel_id, user_id as user_name,
 case when event_type = 'error' then '' when event_type = 'signup' then '#' || event_type
  else event_type || ' ' || cast(user_id as varchar) end as comment from events""",
    "fx_detections": """
select user_id % 10 as device_id, ts, event_id as seq, event_type in ('click','view','purchase') as face_detected from events""",
}
NEEDS = {
    "fx_obs_sources": ["fx_units"],
    "fx_unit_tags": ["fx_units"],
    "fx_models": ["fx_units", "fx_entities", "fx_unit_entities"],
}


def sim_sql(a: str, b: str) -> str:
    """SQL for the cosine similarity as the engine rounds it."""
    return f"round(list_cosine_similarity(cast({a} as double[]), cast({b} as double[])), 9)"


def add_view(name: str, sql: str, *needs: str) -> None:
    """Make ``name`` available to later SQL texts."""
    VIEWS[name] = sql
    NEEDS[name] = list(needs)


def with_views(body: str, names: tuple[str, ...]) -> str:
    """``body`` as one statement that defines the views it names."""
    ordered: list[str] = []

    def need(name: str) -> None:
        for other in NEEDS.get(name, []):
            need(other)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        need(name)
    if not ordered:
        return body.strip()
    defined = ",\n".join(f"{name} as ({VIEWS[name].strip()})" for name in ordered)
    return f"with recursive {defined}\n{body.strip()}"


add_view("fx_timed", "select bank_id, batch_id, unit_id, coalesce(event_date, occurred_start, mentioned_at) as at from fx_units", "fx_units")
add_view(
    "fx_temporal_links",
    """
select distinct bank_id, unnest([u, o]) as from_unit_id, unnest([o, u]) as to_unit_id, 'temporal' as link_type,
 round(greatest(0.3, 1 - gap / 3600e6 / 24), 13) as weight, cast(null as bigint) as entity_id from (
 select a.bank_id, a.unit_id as u, b.unit_id as o, abs(epoch_us(a.at) - epoch_us(b.at)) as gap, a.batch_id = b.batch_id as own,
  row_number() over (partition by a.unit_id, a.batch_id = b.batch_id order by b.at desc, b.unit_id desc) as rn
 from fx_timed a join fx_timed b on a.bank_id = b.bank_id and a.unit_id <> b.unit_id
  and abs(epoch_us(a.at) - epoch_us(b.at)) <= 86400000000) where own or rn <= 10""",
    "fx_timed",
)
add_view(
    "fx_semantic_links",
    f"""
select distinct bank_id, unnest([u, o]) as from_unit_id, unnest([o, u]) as to_unit_id, 'semantic' as link_type,
 similarity as weight, cast(null as bigint) as entity_id from (
 select *, row_number() over (partition by u order by similarity desc, o) as rn from (
  select a.bank_id, a.unit_id as u, b.unit_id as o, a.batch_id = b.batch_id as own,
   {sim_sql("a.embedding", "b.embedding")} as similarity
  from fx_units a join fx_units b on a.bank_id = b.bank_id and a.unit_id <> b.unit_id) where similarity >= {LINK_THRESHOLD})
where own or rn <= 5""",
    "fx_units",
)
add_view(
    "fx_entity_links",
    """
select distinct bank_id, unnest([u, o]) as from_unit_id, unnest([o, u]) as to_unit_id, 'entity' as link_type,
 1.0::double as weight, entity_id from (
 select a.bank_id, a.unit_id as u, b.unit_id as o, x.entity_id, a.batch_id = b.batch_id as own,
  row_number() over (partition by x.entity_id, a.unit_id, a.batch_id = b.batch_id order by b.created_at desc, b.unit_id desc) as rn
 from fx_unit_entities x join fx_unit_entities y on x.entity_id = y.entity_id and x.unit_id <> y.unit_id
  join fx_units a on a.unit_id = x.unit_id join fx_units b on b.unit_id = y.unit_id) where own or rn <= 50""",
    "fx_units",
    "fx_unit_entities",
)
add_view(
    "fx_links",
    """
select * from fx_temporal_links union all select * from fx_semantic_links union all select * from fx_entity_links
union all select a.bank_id, a.unit_id, b.unit_id, 'causes', 0.8, null from fx_units a join fx_units b on b.unit_id = a.unit_id + 5 and a.batch_id = b.batch_id
union all select a.bank_id, b.unit_id, a.unit_id, 'caused_by', 0.8, null from fx_units a join fx_units b on b.unit_id = a.unit_id + 5 and a.batch_id = b.batch_id""",
    "fx_temporal_links",
    "fx_semantic_links",
    "fx_entity_links",
)

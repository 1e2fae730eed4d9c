"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in a pseudo-random order, repeated
once.  A copy's virtual finish time is the cumulative number of words of its
queue, divided by the source's target; all copies are then sorted by it and
cut off where the running number of words passes the total budget.  As every
queue reaches its target at time 1, the cut leaves each source within about
one document of its target.

The order comes from an MD5 of seed, doc_id and text, so reruns agree.  Both
running sums work on blocks of bounded size, so a source with a third of all
rows is spread over many tasks.  Only the table of sources, one row each, is
sorted as a whole.

Defined cases: a null text has no words, a null source is a source of its own
and sorts last, documents without words are never taken, rows of one source
that agree in doc_id and text share one place in the queue, an empty table
gives an empty table, and extra columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from anamnesis.llm.base import BLOCK_ROWS, WORD, free_name, running_sum, whole_text
from anamnesis.session import materialize

WEIGHTS = (3, 1, 2)
SHARE = 1.5
#: A source, and so a document, is taken this many times at most.
REPEATS = 2
SEED = "mix"


def words_in(text: str = "text") -> Column:
    return F.regexp_count(whole_text(text), F.lit(WORD)).cast("bigint")


def queue_key(seed: str = SEED) -> Column:
    """Pseudo-random place of a document in the queue of its source."""
    return F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.md5(whole_text())))


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """(source, source_size, rows) with nr, weight and target.

    The share of all sizes is dealt out by weight; a target stops at
    ``repeats`` times its source's size and the excess goes to the others by
    weight (water filling: sources are filled in the order of limit / weight).
    """
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    numbered = sizes.withColumn("nr", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("nr") - 1) % len(weights) + 1).cast("int"))
    numbered = numbered.withColumn("weight", weight).withColumn("most", F.col("source_size") * repeats)
    fill = Window.orderBy((F.col("most") / F.col("weight")).asc(), F.col("nr").asc()).rowsBetween(Window.unboundedPreceding, -1)
    budget = F.sum("source_size").over(everything) * F.lit(share)
    left = budget - F.coalesce(F.sum("most").over(fill), F.lit(0))
    weights_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(fill), F.lit(0))
    filled = numbered.withColumn("level", left / weights_left)
    first_open = F.min(F.when(F.col("most") / F.col("weight") >= F.col("level"), F.struct((F.col("most") / F.col("weight")).alias("r"), "nr", "level")))
    level = first_open.over(everything)["level"]
    target = F.when(level.isNull(), F.col("most").cast("double")).otherwise(F.least(F.col("most").cast("double"), level * F.col("weight")))
    return filled.withColumn("target", target).select("source", "source_size", "rows", "nr", "weight", "target")


def _unit(key: str) -> Column:
    """First 32 bits of a hex digest as a number in [0, 1)."""
    return F.conv(F.substring(key, 1, 8), 16, 10).cast("bigint") / F.lit(float(1 << 32))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, repeats: int = REPEATS, seed: str = SEED) -> tuple[DataFrame, DataFrame]:
    """(entries, taken copies).

    Entries: source, key, doc_id, size, n (rows), and their source's nr,
    source_size and target.  Copies: source, key, doc_id, size, n, finish and
    epoch of every copy that the mix takes.
    """
    thin = docs.select("doc_id", "source", words_in().alias("size"), queue_key(seed).alias("key"))
    entries = thin.groupBy("source", "key", "doc_id", "size").agg(F.count("*").alias("n"))
    entries = materialize(entries, "mix-entries").withColumn("words", F.col("size") * F.col("n"))
    sizes = entries.groupBy("source").agg(F.sum("words").alias("source_size"), F.count("*").alias("rows"))
    plan = materialize(targets(sizes, weights, share, repeats), "mix-targets").alias("p")
    planned = entries.alias("e").join(plan, F.col("e.source").eqNullSafe(F.col("p.source"))).select("e.*", "p.source_size", "p.rows", "p.nr", "p.target")

    queued = running_sum(planned, ["nr"], ["key"], _unit("key") * F.col("rows") / BLOCK_ROWS, "words", "served")
    copies = queued.filter("size > 0").withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
    finish = (F.col("served") + (F.col("epoch") - 1) * F.col("source_size")) / F.col("target")
    # no queue is behind its target at time 1, so copies that finish after time 2 can't be reached
    copies = materialize(copies.withColumn("finish", finish).filter("finish < 2"), "mix-copies")

    budget = plan.agg(F.sum("target")).first()[0] or 0.0
    place = F.col("finish") * (copies.count() / BLOCK_ROWS)
    sorted_ = running_sum(copies, [], ["finish", "nr", "key", "epoch"], place, "words", "mixed")
    return planned, sorted_.filter(F.col("mixed") <= F.lit(budget)).select("source", "nr", "key", "doc_id", "size", "n", "epoch", "finish")


def mix_report(docs: DataFrame, **options) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, taken."""
    entries, copies = mix(docs, **options)
    epochs = copies.groupBy("nr", "key").agg(F.count("*").alias("epochs"))
    return (
        entries.join(epochs, ["nr", "key"], "left")
        .withColumn("_copy", F.explode(F.expr("sequence(1L, n)")))
        .select("doc_id", "size", "source_size", "target", (F.col("size") * F.coalesce("epochs", F.lit(0))).alias("taken"), "source")
    )


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The taken documents with all their columns, as often as they are taken, in the order of the mix."""
    _, copies = mix(docs, **options)
    key, finish, epoch = (free_name(docs, c) for c in ("key", "finish", "epoch"))
    copies = copies.select(F.col("source").alias("_s"), F.col("key").alias("_k"), F.col("finish").alias(finish), F.col("epoch").alias(epoch))
    texts = docs.withColumn(key, queue_key(options.get("seed", SEED)))
    taken = texts.join(copies, (F.col(key) == F.col("_k")) & F.col("source").eqNullSafe(F.col("_s")))
    return taken.repartitionByRange(F.col(finish), F.col(key)).sortWithinPartitions(finish, key).select(docs.columns)


SQL = r"""
WITH thin AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5('mix|' || coalesce(doc_id::varchar, 'null') || '|' || md5(coalesce(text, ''))) AS key
  FROM documents),
sizes AS (
  SELECT source, sum(size)::bigint AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) AS nr FROM thin GROUP BY source),
weighed AS (SELECT *, ([3, 1, 2])[((nr - 1) % 3 + 1)::int] AS weight, source_size * 2 AS most FROM sizes),
filled AS (
  SELECT *, ((sum(source_size) OVER ())::double * 1.5
             - coalesce(sum(most) OVER (ORDER BY most::double / weight, nr ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::double)
            / ((sum(weight) OVER ()) - coalesce(sum(weight) OVER (ORDER BY most::double / weight, nr ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::double AS level
  FROM weighed),
planned AS (
  SELECT *, least(most::double, (SELECT arg_min(level, most::double / weight) FROM filled WHERE most::double / weight >= level) * weight) AS target FROM filled),
queued AS (
  SELECT t.*, p.nr, p.source_size, p.target, sum(size) OVER (PARTITION BY p.nr ORDER BY key) AS served
  FROM thin t JOIN planned p ON t.source IS NOT DISTINCT FROM p.source),
copies AS (
  SELECT *, ((served + (epoch - 1) * source_size)::double / target) AS finish
  FROM queued, (SELECT unnest([1, 2]) AS epoch) WHERE size > 0),
mixed AS (SELECT *, sum(size) OVER (ORDER BY finish, nr, key, epoch) AS mixed FROM copies),
epochs AS (SELECT nr, key, count(*) AS epochs FROM mixed WHERE mixed <= (SELECT sum(target) FROM planned) GROUP BY 1, 2)
SELECT q.doc_id, q.size::bigint AS size, q.source_size, q.target, (q.size * coalesce(e.epochs, 0))::bigint AS taken, q.source
FROM queued q LEFT JOIN epochs e ON e.nr = q.nr AND e.key = q.key
"""

"""Line deduplication by distributed prefix doubling over line numbers.

Every line that isn't blank is a symbol (its MD5).  A suffix is named by its
first 2, then 4, 8 ... lines: the name of a suffix for twice as many lines is
the hash of its own name and the name of the suffix that many lines later,
which stands in the same document.  Names stand in for ranks, so a round needs
no global sort; the suffixes of one name are an interval of the suffix array
whose longest common prefix is at least that long.  Suffixes that are alone in
their interval leave the game, so a round works only on what repeats, and the
rounds end with the longest repeated run.

A run of RUN lines or more, or a single line of LONG words or more, that
occurred earlier (smaller doc_id, then earlier line) is a later copy.  Every
suffix that isn't the first of its interval says (start, length of the
interval); these stretches are merged per document and their lines removed.
With ``runs``, the exact common prefix with the earliest place of the longest
interval is found for the first suffix of each copied stretch by going down the
names again; the longest of a document is reported.

Everything is DataFrame and SQL functions.  A very common line is a group with
a first and a last place, joined back by a join that Spark can split.  Only rows
that pass a sieve go to a join: a bitmap of SIEVE_BITS hashed keys, 8 MB however
many keys there are.  It never loses a row; when the keys outnumber its bits it
lets all rows pass, and texts that lose no line are shuffled in vain.

Defined cases: a null or empty text has no lines; blank lines have no name and
stay; a null doc_id comes last; rows that agree in doc_id and text are one
document and get equal results; an empty table gives an empty table; extra
columns are carried along by ``drop_repeated_lines``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from anamnesis.llm.base import WORD, free_name, whole_text
from anamnesis.session import materialize

#: Lines of a repeated run at least; a single line of LONG words is one too.
RUN = 2
LONG = 50
#: Bits of a sieve.
SIEVE_BITS = 1 << 26
_PLACE = ("doc_id", "document", "seq")


def document_key() -> Column:
    return F.unhex(F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), whole_text())))


def line_names(docs: DataFrame) -> DataFrame:
    """doc_id, document, lines: name and long of every line that isn't blank."""
    words = f"regexp_count(l, '{WORD.replace(chr(92), chr(92) * 2)}')"
    filled = "filter(split(coalesce(text, ''), '\\n', -1), l -> trim(l) != '')"
    named = F.expr(f"transform({filled}, l -> struct(unhex(md5(l)) as name, {words} >= {LONG} as long))")
    return docs.select("doc_id", document_key().alias("document"), named.alias("lines"))


def first_suffixes(lines: DataFrame) -> DataFrame:
    """doc_id, document, seq, length, name: long lines (length 1) and pairs of lines (length RUN)."""
    placed = "transform(lines, (x, i) -> struct(i as seq, x.name as name, x.long as long))"
    single = f"transform(filter({placed}, x -> x.long), x -> struct(x.seq as seq, 1 as length, x.name as name))"
    pairs = f"transform(slice(lines, 1, greatest(size(lines) - 1, 0)), (x, i) -> struct(i as seq, {RUN} as length, unhex(md5(concat(x.name, lines[i + 1].name))) as name))"
    return lines.select("doc_id", "document", F.explode(F.expr(f"concat({single}, {pairs})")).alias("suffix")).select("doc_id", "document", "suffix.*")


def _slot(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(SIEVE_BITS)) + 1


def sieve(keys: DataFrame, key: str) -> DataFrame:
    """Bitmaps of the hashed keys: at most SIEVE_BITS / 32768 rows of 4 KB."""
    slot = _slot(F.col(key))
    return keys.groupBy(F.bitmap_bucket_number(slot).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits"))


def _sifted(rows: DataFrame, key: Column, holes: DataFrame, name: str) -> DataFrame:
    """``rows`` with the boolean ``name``: false only where ``key`` isn't among the keys of the sieve."""
    bucket, bits, slot = free_name(rows, "bucket"), free_name(rows, "bits"), free_name(rows, "slot")
    holes = holes.select(F.col("bucket").alias(bucket), F.col("bits").alias(bits))
    at = rows.withColumn(slot, _slot(key))
    found = at.join(F.broadcast(holes), F.bitmap_bucket_number(slot) == F.col(bucket), "left")
    bit = F.bitmap_bit_position(slot)
    byte = F.conv(F.hex(F.substring(F.col(bits), F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    held = F.coalesce(F.getbit(byte, (bit % 8).cast("int")) == 1, F.lit(False))
    return found.withColumn(name, held).select(*rows.columns, name)


def _shared_names(suffixes: DataFrame) -> DataFrame:
    """length and name that stand at two places or more, with the first place."""
    place = F.struct(F.col("doc_id").isNull().alias("last"), *_PLACE)
    ends = suffixes.groupBy("length", "name").agg(F.min(place).alias("first"), F.max(place).alias("end"))
    return ends.filter("NOT first <=> end").select("length", "name", "first")


def _later() -> Column:
    return ~(F.col("document").eqNullSafe(F.col("first.document")) & (F.col("seq") == F.col("first.seq")))


def intervals(lines: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Suffixes that others equal in ``length`` lines, with the first place: long single lines, then by level 2, 4, 8 ..."""
    suffixes = first_suffixes(lines)
    shared = materialize(_shared_names(suffixes), "shared-names")
    held = _sifted(suffixes, F.col("name"), materialize(sieve(shared, "name"), "name-sieve"), "held").filter("held").drop("held")
    # equal rows of the input are one document
    start = held.join(shared, ["length", "name"]).repartition("document").dropDuplicates(["document", "seq", "length"])
    start = materialize(start, "suffixes-2")
    levels = [start.filter(F.col("length") == RUN)]
    length = RUN
    while levels[-1].limit(1).count():
        ahead = Window.partitionBy("document").orderBy("seq").rangeBetween(length, length)
        longer = levels[-1].select(*_PLACE, "name", F.first("name").over(ahead).alias("next")).filter("next IS NOT NULL")
        length *= 2
        longer = longer.select(*_PLACE, F.lit(length).alias("length"), F.unhex(F.md5(F.concat("name", "next"))).alias("name"))
        levels.append(materialize(longer.join(_shared_names(longer), ["length", "name"]), f"suffixes-{length}"))
    return start.filter("length = 1"), levels[:-1]


def copied_stretches(single: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """document and its stretches (start, end) of lines to remove, without overlap."""
    copies = single.filter(_later()).select("document", "seq", "length")
    for level in levels:
        copies = copies.unionByName(level.filter(_later()).select("document", "seq", "length"))
    order = Window.partitionBy("document").orderBy("seq", "length")
    reached = F.max(F.col("seq") + F.col("length")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = copies.withColumn("opens", (reached.isNull() | (F.col("seq") > reached)).cast("int"))
    numbered = opened.withColumn("stretch", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = numbered.groupBy("document", "stretch").agg(F.min("seq").alias("start"), F.max(F.col("seq") + F.col("length")).alias("end"))
    return merged.groupBy("document").agg(F.collect_list(F.struct("start", "end")).alias("stretches"))


def copied_runs(lines: DataFrame, single: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """document, seq, first and exact length of the run at the start of every copied stretch."""
    single = single.filter(_later()).select("document", "seq", "first", "length")
    if not levels:
        return single
    # the first suffix of every stretch of copies, with the first place of its longest interval
    order = Window.partitionBy("document").orderBy("seq")
    heads = levels[0].filter(_later()).withColumn("before", F.lag("seq").over(order)).filter("before IS NULL OR before < seq - 1")
    runs = heads.select("document", "seq", "first", "length")
    for level in levels[1:]:
        higher = level.filter(_later()).select("document", "seq", F.col("first").alias("farther"), F.col("length").alias("more"))
        runs = runs.join(higher, ["document", "seq"], "left")
        runs = runs.select("document", "seq", F.coalesce("farther", "first").alias("first"), F.coalesce("more", "length").alias("length"))
    # going down, the common prefix grows by a level's lines where both places go on with the same name
    symbols = lines.select("document", F.posexplode("lines").alias("seq", "line")).select("document", "seq", F.lit(1).alias("length"), "line.name").distinct()
    for names in [*reversed(levels), symbols]:
        here = names.select("document", F.col("seq").alias("at"), F.col("name").alias("here"), F.col("length").alias("step"))
        there = names.select(F.col("document").alias("other"), F.col("seq").alias("there_at"), F.col("name").alias("there"))
        runs = runs.withColumn("at", F.col("seq") + F.col("length")).join(here, ["document", "at"], "left")
        runs = runs.withColumn("other", F.col("first.document")).withColumn("there_at", F.col("first.seq") + F.col("length"))
        runs = runs.join(there, ["other", "there_at"], "left")
        grown = F.when(F.col("here") == F.col("there"), F.col("length") + F.col("step")).otherwise(F.col("length"))
        runs = runs.select("document", "seq", "first", grown.alias("length"))
    return runs.unionByName(single)


def _cleaned(docs: DataFrame, runs: bool = False) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with columns for its lines, the places of lines to remove (null: none) and the longest copied run; their names."""
    lines = materialize(line_names(docs.select("doc_id", "text")), "lines")
    single, levels = intervals(lines)
    changes = copied_stretches(single, levels)
    if runs:
        longest = copied_runs(lines, single, levels).groupBy("document").agg(F.max("length").alias("longest"))
        changes = changes.join(longest, "document", "left")
    else:
        changes = changes.withColumn("longest", F.lit(None).cast("int"))
    changes = materialize(changes, "line-changes")
    at = {c: free_name(docs, c) for c in ("document", "changed", "found", "stretches", "longest", "lines", "gone")}
    found = changes.select(*[F.col(c).alias(at[k]) for c, k in (("document", "found"), ("stretches", "stretches"), ("longest", "longest"))])
    keyed = docs.withColumn(at["document"], document_key())
    keyed = _sifted(keyed, F.col(at["document"]), materialize(sieve(changes, "document"), "document-sieve"), at["changed"])
    changed = keyed.filter(F.col(at["changed"])).join(found, F.col(at["document"]) == F.col(at["found"]), "left")
    same = keyed.filter(~F.col(at["changed"])).select("*", *[F.lit(None).cast(found.schema[c].dataType).alias(c) for c in found.columns])
    # lines that aren't blank are counted, all lines are placed
    texts = changed.unionByName(same).withColumn(at["lines"], F.split(whole_text(), "\n", -1))
    filled = f"filter(sequence(0, size(`{at['lines']}`) - 1), i -> trim(`{at['lines']}`[i]) != '')"
    counted = f"flatten(transform(`{at['stretches']}`, s -> sequence(s.start, s.end - 1)))"
    gone = f"CASE WHEN `{at['stretches']}` IS NOT NULL THEN transform(array({filled}), f -> transform({counted}, c -> f[c]))[0] END"
    return texts.withColumn(at["gone"], F.expr(gone)), at


def _left_text(at: dict[str, str]) -> Column:
    lines, gone = at["lines"], at["gone"]
    kept = f"transform(array_except(sequence(0, size(`{lines}`) - 1), `{gone}`), i -> get(`{lines}`, i))"
    return F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.expr(f"array_join({kept}, '\n')"))


def drop_repeated_lines(docs: DataFrame) -> DataFrame:
    """``docs`` without the later copies of repeated line runs."""
    texts, at = _cleaned(docs)
    return texts.withColumn("text", _left_text(at)).select(docs.columns)


def line_report(docs: DataFrame, runs: bool = False) -> DataFrame:
    """doc_id, n_lines (that aren't blank), n_removed, text (what is left); with ``runs`` also longest_run."""
    texts, at = _cleaned(docs.select("doc_id", "text"), runs)
    return texts.select(
        "doc_id",
        F.expr(f"size(filter(`{at['lines']}`, l -> trim(l) != ''))").cast("bigint").alias("n_lines"),
        F.coalesce(F.when(F.col(at["gone"]).isNotNull(), F.size(at["gone"])), F.lit(0)).cast("bigint").alias("n_removed"),
        _left_text(at).alias("text"),
        *([F.coalesce(at["longest"], F.lit(0)).cast("bigint").alias("longest_run")] if runs else []),
    )


SQL = r"""
WITH RECURSIVE docs AS (
  SELECT DISTINCT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS arr FROM documents),
lines AS (
  SELECT doc_id, text, row_number() OVER (PARTITION BY doc_id, text ORDER BY pos) AS seq, pos, line
  FROM (SELECT doc_id, text, unnest(range(len(arr))) AS pos, unnest(arr) AS line FROM docs) WHERE trim(line) <> ''),
pairs AS (
  SELECT *, lead(line) OVER w AS line2, lead(pos) OVER w AS pos2 FROM lines WINDOW w AS (PARTITION BY doc_id, text ORDER BY seq)),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY line, line2 ORDER BY doc_id NULLS LAST, md5(coalesce(doc_id::varchar, 'null') || '|' || text), seq) AS nth,
         first_value(doc_id) OVER f AS first_doc, first_value(text) OVER f AS first_text, first_value(seq) OVER f AS first_seq
  FROM pairs WHERE line2 IS NOT NULL
  WINDOW f AS (PARTITION BY line, line2 ORDER BY doc_id NULLS LAST, md5(coalesce(doc_id::varchar, 'null') || '|' || text), seq)),
long AS (
  SELECT doc_id, text, pos, row_number() OVER (PARTITION BY line ORDER BY doc_id NULLS LAST, md5(coalesce(doc_id::varchar, 'null') || '|' || text), seq) AS nth
  FROM lines WHERE len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) >= 50),
gone AS (
  SELECT DISTINCT doc_id, text, pos FROM (
    SELECT doc_id, text, pos FROM placed WHERE nth > 1 UNION ALL
    SELECT doc_id, text, pos2 FROM placed WHERE nth > 1 UNION ALL
    SELECT doc_id, text, pos FROM long WHERE nth > 1)),
lists AS (SELECT doc_id, text, list(pos) AS gone FROM gone GROUP BY 1, 2)
SELECT d.doc_id, len(list_filter(d.arr, lambda l: trim(l) <> ''))::bigint AS n_lines, coalesce(len(g.gone), 0)::bigint AS n_removed,
       CASE WHEN g.gone IS NULL THEN o.text ELSE array_to_string(list_filter(d.arr, lambda l, i: NOT list_contains(g.gone, i - 1)), chr(10)) END AS text
FROM documents o
JOIN docs d ON d.doc_id IS NOT DISTINCT FROM o.doc_id AND d.text = coalesce(o.text, '')
LEFT JOIN lists g ON g.doc_id IS NOT DISTINCT FROM d.doc_id AND g.text = d.text
"""

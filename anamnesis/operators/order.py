"""Ordered operations that do not put a hot key into one task.

A plain window over a key sorts the whole key in one task.  Here each key is
cut into blocks by a monotone expression of its order (a range of turn numbers,
a slice of time); windows run inside a block, and one summary row per block
carries the missing bit of context over to the next block.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from anamnesis.session import materialize

TURNS_PER_BLOCK = 65_536
SECONDS_PER_BLOCK = 3_600


def turn_block(turn: str) -> Column:
    """Block of a dense position: at most TURNS_PER_BLOCK rows share one."""
    return F.floor(F.col(turn) / TURNS_PER_BLOCK).cast("bigint")


def time_block(ts: str, seconds: int = SECONDS_PER_BLOCK) -> Column:
    return F.floor(F.unix_seconds(F.col(ts)) / seconds).cast("bigint")


def numbered(df: DataFrame, order: Sequence[str], name: str, first: int = 0) -> DataFrame:
    """Add ``name``: consecutive numbers from ``first`` in the order of the columns.

    Rows are range-partitioned and sorted; the sizes of the partitions before are added to a row's place in its own.
    """
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("bigint"), 33)
    rows = materialize(rows.withColumns({"_part": F.spark_partition_id(), "_place": place}), name)
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_size"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_start"))
    number = F.lit(first).cast("bigint") + F.col("_start") + F.col("_place")
    return rows.join(starts, "_part").withColumn(name, number).drop("_part", "_place", "_start")


def spread_out(df: DataFrame, *keys: str) -> DataFrame:
    """Deal rows by ``keys`` to as many tasks as the session shuffles to.

    For few bytes that cost much computation: left alone, adaptive execution would merge them into a few tasks.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def with_previous(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column, fields: Sequence[str], name: str = "prev"
) -> DataFrame:
    """Add ``name``: struct of ``fields`` of the row before, NULL on a key's first row."""
    rows = df.withColumn("_block", block)
    value = F.struct(*fields)
    inside = Window.partitionBy(*keys, "_block").orderBy(*order)
    tails = rows.groupBy(*keys, "_block").agg(F.max_by(value, F.struct(*order)).alias("_tail"))
    across = Window.partitionBy(*keys).orderBy("_block")
    carried = tails.select(*keys, "_block", F.lag("_tail").over(across).alias("_carried"))
    return (
        rows.withColumn("_inside", F.lag(value).over(inside))
        .join(carried, [*keys, "_block"])
        .withColumn(name, F.coalesce("_inside", "_carried"))
        .drop("_block", "_inside", "_carried")
    )


def with_run(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column, starts: Column, name: str = "run"
) -> DataFrame:
    """Add ``name``: struct of the order columns of the row that began the current run.

    ``starts`` is true on rows that begin a run; the first row of a key must be one.
    """
    rows = df.withColumn("_block", block).withColumn("_start", F.when(starts, F.struct(*order)))
    inside = Window.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    heads = rows.groupBy(*keys, "_block").agg(F.max("_start").alias("_head"))
    across = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = heads.select(*keys, "_block", F.max("_head").over(across).alias("_carried"))
    return (
        rows.withColumn("_inside", F.max("_start").over(inside))
        .join(carried, [*keys, "_block"])
        .withColumn(name, F.coalesce("_inside", "_carried"))
        .drop("_block", "_start", "_inside", "_carried")
    )


def with_running_sum(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column, value: Column, name: str, slices: Sequence[Column] = ()
) -> DataFrame:
    """Add ``name``: sum of ``value`` over the key up to and including the row.

    ``slices`` cut a block further where one value of the order can have any number of rows: sorted by these columns,
    a block is in its order, and only rows that agree in all of them meet in a window.
    """
    cut = [f"_slice{i}" for i in range(len(slices))]
    rows = df.withColumns({"_block": block, "_value": value} | dict(zip(cut, slices, strict=True)))
    before = lambda w: F.coalesce(F.sum("_sum").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = Window.partitionBy(*keys, "_block", *cut).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    parts = rows.groupBy(*keys, "_block", *cut).agg(F.sum("_value").alias("_sum"))
    sums = parts.groupBy(*keys, "_block").agg(F.sum("_sum").alias("_sum"))
    carried = sums.select(*keys, "_block", before(Window.partitionBy(*keys).orderBy("_block")).alias("_carried"))
    out = rows.withColumn("_inside", F.sum("_value").over(inside)).join(carried, [*keys, "_block"])
    total = F.col("_inside") + F.col("_carried")
    if cut:
        within = Window.partitionBy(*keys, "_block").orderBy(*cut)
        out = out.join(parts.select(*keys, "_block", *cut, before(within).alias("_earlier")), [*keys, "_block", *cut])
        total = total + F.col("_earlier")
    return out.withColumn(name, total).drop("_block", "_value", "_inside", "_earlier", "_carried", *cut)


def top(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, name: str = "rn") -> DataFrame:
    """The first ``n`` rows of each key with their 1-based rank.

    Spark cuts each map-side partition to ``n`` rows a key before the shuffle,
    so a hot key sends at most n rows a task.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(window)).filter(F.col(name) <= n)

"""Small helpers that several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: A word: anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows of a block of an ordered key, and blocks of a block of blocks.
BLOCK_ROWS = 256
BLOCK_BLOCKS = 256


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` has it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def whole_text(text: str = "text") -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """``text`` with A-Z in lower case and every other character as it is."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def running_sum(rows: DataFrame, keys: Sequence[str], order: Sequence[str], place: Column, value: str, name: str) -> DataFrame:
    """Add ``name``: the sum of ``value`` over the rows of ``keys`` up to and including the row, in ``order``.

    ``place`` is a non-negative number that grows with ``order``, and about BLOCK_ROWS rows of a key share its whole
    part.  Only rows of one block meet in a window; blocks, and blocks of blocks, carry their sums over.
    """
    blocks = rows.withColumn("_block", F.floor(place).cast("bigint"))
    sums = blocks.groupBy(*keys, "_block").agg(F.sum(value).alias("_sum")).withColumn("_upper", F.floor(F.col("_block") / BLOCK_BLOCKS))
    uppers = sums.groupBy(*keys, "_upper").agg(F.sum("_sum").alias("_sum"))
    before = lambda w: F.coalesce(F.sum("_sum").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    uppers = uppers.select(*keys, "_upper", before(Window.partitionBy(*keys).orderBy("_upper")).alias("_upper_before"))
    lowers = sums.select(*keys, "_block", "_upper", before(Window.partitionBy(*keys, "_upper").orderBy("_block")).alias("_block_before"))
    lowers, uppers = lowers.alias("l"), uppers.alias("u")
    on = [F.col(f"l.{c}").eqNullSafe(F.col(f"u.{c}")) for c in [*keys, "_upper"]]
    offsets = lowers.join(uppers, on).select(*[F.col(f"l.{c}") for c in [*keys, "_block"]], (F.col("_block_before") + F.col("_upper_before")).alias("_before"))
    inside = Window.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = blocks.withColumn("_inside", F.sum(value).over(inside)).alias("r")
    offsets = offsets.alias("o")
    on = [F.col(f"r.{c}").eqNullSafe(F.col(f"o.{c}")) for c in [*keys, "_block"]]
    columns = [F.col(f"r.{c}") for c in rows.columns]
    return summed.join(offsets, on).select(*columns, (F.col("_inside") + F.col("_before")).alias(name))

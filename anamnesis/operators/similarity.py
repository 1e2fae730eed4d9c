"""Vector search and similarity joins.

Both sides are cut into blocks of bounded size inside their key (bank); every
pair of blocks is one Arrow batch multiplied by numpy in a task and only rows
above the threshold - and, for a top-k search, only the block's best k per
query - leave it.  A key that holds a third of all rows becomes many blocks,
so no task ever holds more than two of them.

For high thresholds the vectors are first assigned to the nearest of a few
pivot vectors, and a query visits only the cells that can hold a match (the
triangle inequality on unit vectors makes the pruning exact).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from anamnesis.functions.vector import SIM_DIGITS
from anamnesis.operators.order import top

# vectors of both sides that meet in one task: the more, the fewer copies of each side are shuffled
ROWS_PER_BLOCK = 131_072
# a key's queries are cut into so many blocks at least, if these hold enough queries to be worth a copy of the units
QUERY_BLOCKS, LEAST_QUERIES = 4, 2_048
PIVOTS = 32
PRUNE_FROM = 0.6
# vectors that are tried before cells are used, and cells that these may visit on average
TRIED, VISITED = 512, 8
# queries, approximate scores, and pairs with their exact scores, that are held at once
QUERIES_PER_STEP = 512
SCORES_PER_STEP = 1 << 19
PAIRS_PER_STEP = 1 << 16
# found pairs that leave a task at once
PAIRS_PER_BATCH = 1 << 18
# queries that are few enough to be sent to the units, and units that meet them at once
FEW_QUERIES, UNITS_PER_STEP = 8_192, 32_768
# pairs are scored one by one if less than one of so many is close
DENSE_FROM = 32
SLACK = 1e-6


def unit_rows(column: pa.ChunkedArray) -> np.ndarray:
    """A list column as a matrix of unit-length rows; zero vectors stay zero."""
    values = column.combine_chunks()
    flat = np.asarray(values.flatten(), dtype=np.float64)
    if len(values) == 0:
        return np.zeros((0, 0))
    if len(flat) % len(values) or len(set(values.value_lengths().to_pylist())) > 1:
        raise ValueError("vectors differ in length")
    rows = flat.reshape(len(values), -1)
    length = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return np.divide(rows, length, out=np.zeros_like(rows), where=length > 0)


def _codes(column: pa.ChunkedArray) -> np.ndarray:
    """Order-preserving integer codes of a column."""
    return np.unique(column.to_numpy(zero_copy_only=False), return_inverse=True)[1]


def _true(hit: np.ndarray) -> np.ndarray:
    """``flatnonzero``, eight at a time where few are true."""
    flat = hit.ravel()
    if len(flat) % 8 or np.count_nonzero(flat) * 16 > len(flat):
        return np.flatnonzero(flat)
    eights = np.flatnonzero(flat.view(np.uint64))
    eight, place = np.nonzero(flat.reshape(-1, 8)[eights])
    return eights[eight] * 8 + place


def _close(scores: np.ndarray, least: float | np.ndarray, k: int | None, margin: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of approximate scores that may reach ``least`` and, with ``k``, be among the row's k highest.

    ``margin`` is how far two scores that are close to each other may change places.
    """
    hit = scores >= least
    if k is not None and scores.shape[1] > k and np.count_nonzero(hit) > 2 * k * len(scores):
        # a score that isn't a number is below all others
        ranked = np.where(np.isnan(scores), -np.inf, scores) if np.isnan(scores).any() else scores
        kth = np.partition(ranked, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
        hit &= scores >= kth[:, None] - np.float32(margin)
    return np.divmod(_true(hit), scores.shape[1])


def _candidates(asked: np.ndarray, stored: np.ndarray, least: float, k: int | None, margin: float) -> tuple[np.ndarray, np.ndarray]:
    """(row of ``asked``, row of ``stored``) as ``_close`` has them, from single-precision vectors, some of ``stored`` at a time.

    With ``k``, the k-th highest score of a row so far is its bound for the rest: soon hardly a score reaches it.
    """
    width = max(1, SCORES_PER_STEP // len(asked))
    bound = np.full((len(asked), 1), least, dtype=np.float32)
    best = None if k is None else np.full((len(asked), k), -np.inf, dtype=np.float32)
    rows, cols, scores = [], [], []
    for begin in range(0, len(stored), width):
        some = asked @ stored[begin : begin + width].T
        row, col = _close(some, bound, k, margin)
        score = some[row, col]
        rows.append(row)
        cols.append(col + begin)
        scores.append(score)
        if best is not None and len(row):
            # the scores of a row side by side, and its k highest until now
            count = np.bincount(row, minlength=len(asked))
            place = np.arange(len(row)) - (np.cumsum(count) - count)[row]
            wide = np.full((len(asked), k + count.max()), -np.inf, dtype=np.float32)
            wide[:, :k] = best
            wide[row, k + place] = score
            best = np.partition(wide, count.max(), axis=1)[:, count.max() :]
            bound = np.maximum(bound, best.min(axis=1, keepdims=True) - np.float32(margin))
    row, col, score = (np.concatenate(part) if part else np.zeros(0, dtype=np.int64) for part in (rows, cols, scores))
    left = score >= bound[row, 0]
    return row[left], col[left]


def _exact(asked: np.ndarray, stored: np.ndarray, row: np.ndarray, col: np.ndarray) -> np.ndarray:
    """Scores of the pairs in double precision."""
    out = np.empty(len(row))
    if len(row) * DENSE_FROM < len(asked) * len(stored):
        for begin in range(0, len(row), PAIRS_PER_STEP):
            some = slice(begin, begin + PAIRS_PER_STEP)
            out[some] = np.einsum("ij,ij->i", asked[row[some]], stored[col[some]])
        return out
    step = max(1, SCORES_PER_STEP // len(stored))
    for begin in range(0, len(asked), step):
        some = np.flatnonzero((row >= begin) & (row < begin + step))
        out[some] = (asked[begin : begin + step] @ stored.T)[row[some] - begin, col[some]]
    return out


def _sides(batches: Iterator[pa.RecordBatch]) -> tuple[pa.Table, pa.Table]:
    """Units and queries of one pair of blocks."""
    units, queries = [], []
    for batch in batches:
        table = pa.Table.from_batches([batch])
        units.append(table.filter(pc.invert(table["_asks"])))
        queries.append(table.filter(table["_asks"]))
    return pa.concat_tables(units), pa.concat_tables(queries)


def _block_search(threshold: float, k: int | None, pairs: bool, per: str | None, schema: pa.Schema):
    """Kernel for one (units block, queries block) pair.

    A product of single precision leaves the pairs that its rounding error can't rule out: few, unless most pairs
    are wanted.  Only these are scored in double precision, compared with the threshold and ranked.  What is found
    leaves the kernel some at a time, so that its memory doesn't grow with the pairs of a block.
    """

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, queries = _sides(batches)
        if units.num_rows == 0 or queries.num_rows == 0:
            return
        stored, asked = unit_rows(units["_vec"]), unit_rows(queries["_vec"])
        if stored.shape[1] != asked.shape[1]:
            raise ValueError("vectors differ in length")
        unit_ids, query_ids = units["_uid"].combine_chunks(), queries["_qid"].combine_chunks()
        kinds = units[per].combine_chunks() if per else None
        order = _codes(units["_uid"])
        group = _codes(units[per]) if per else np.zeros(units.num_rows, dtype=np.int64)
        members = [np.flatnonzero(group == g) for g in range(group.max() + 1)] if per else [np.arange(units.num_rows)]
        wanted = k
        if pairs:
            both = _codes(pa.chunked_array([*units["_uid"].chunks, *queries["_qid"].chunks]))
            unit_codes, query_codes = both[: units.num_rows], both[units.num_rows :]
            # rows of the query's own id are left out after the k best were looked for
            wanted = None if k is None else k + int(np.bincount(unit_codes).max())
        del units, queries
        # the sum of n products of numbers whose squares sum to 1, rounded at each step
        error = (stored.shape[1] + 8) * 2.0**-23
        digit = 10.0**-SIM_DIGITS
        least = np.float32(threshold - error - digit)
        fast = [(columns, stored[columns].astype(np.float32)) for columns in members]

        def near(some: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, slice]]:
            """(row, column, place, slice): pairs that may be wanted, by places in a slice of the units; those of a row are together if ranked."""
            low = some.astype(np.float32)
            if k is None:
                width = max(1, SCORES_PER_STEP // len(some))
                for begin in range(0, len(stored), width):
                    part = slice(begin, begin + width)
                    row, col = _close(low @ fast[0][1][part].T, least, None, 0.0)
                    yield row, col + begin, col, part
                return
            found = [(row, columns[col]) for columns, vectors in fast for row, col in [_candidates(low, vectors, least, wanted, 2 * error + digit)]]
            row, col = (np.concatenate(side) for side in zip(*found, strict=True))
            yield row, col, col, slice(None)

        def found() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            for begin in range(0, len(asked), QUERIES_PER_STEP):
                some = asked[begin : begin + QUERIES_PER_STEP]
                for row, col, place, part in near(some):
                    score = np.round(_exact(some, stored[part], row, place), SIM_DIGITS)
                    hit = score >= threshold
                    if pairs:
                        hit &= query_codes[begin + row] != unit_codes[col]
                    row, col, score = row[hit], col[hit], score[hit]
                    if k is not None:
                        best = np.lexsort((order[col], -score, group[col], row))
                        row, col, score = row[best], col[best], score[best]
                        slot = row.astype(np.int64) * (group.max() + 1) + group[col]
                        first = np.r_[True, slot[1:] != slot[:-1]] if len(slot) else np.zeros(0, dtype=bool)
                        begin_of = np.maximum.accumulate(np.where(first, np.arange(len(slot)), 0))
                        keep = np.arange(len(slot)) - begin_of < k
                        row, col, score = row[keep], col[keep], score[keep]
                    yield row + begin, col, score

        def batch(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
            rows, cols, scores = (np.concatenate(side) for side in zip(*parts, strict=True))
            out = {"_qid": query_ids.take(pa.array(rows)), "_uid": unit_ids.take(pa.array(cols)), "similarity": pa.array(scores)}
            if per:
                out[per] = kinds.take(pa.array(cols))
            return pa.RecordBatch.from_arrays([out[n].cast(schema.field(n).type) for n in schema.names], schema=schema)

        held, size = [], 0
        for part in found():
            held.append(part)
            size += len(part[0])
            if size >= PAIRS_PER_BATCH:
                yield batch(held)
                held, size = [], 0
        if size:
            yield batch(held)

    return search


def _pivot_rows(units: DataFrame, reach: float) -> np.ndarray:
    """A fixed number of pivot vectors, chosen by the hash of their id; none where most queries would visit most cells.

    Each visit is a copy of the query, and of no use if all cells are visited.  Some vectors, chosen like the pivots,
    are tried; they decide how the search goes, not what it finds.
    """
    picked = units.select("_uid", "_vec").orderBy(F.xxhash64("_uid"), "_uid").limit(PIVOTS + TRIED).collect()
    if not picked:
        return np.zeros((0, 0))
    rows = np.asarray([r["_vec"] for r in picked], dtype=np.float64)
    length = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    rows = np.divide(rows, length, out=np.zeros_like(rows), where=length > 0)
    pivots, tried = rows[:PIVOTS], rows[PIVOTS:]
    if len(tried) and _visited(tried, pivots, reach).sum() > VISITED * len(tried):
        return np.zeros((0, 0))
    return pivots


def _visited(rows: np.ndarray, pivots: np.ndarray, reach: float) -> np.ndarray:
    """Whether a cell can hold vectors within ``reach`` of a row, for each row and cell."""
    # unit vectors: |x - p|^2 = 2 - 2 x.p ; a zero vector matches nothing
    distance = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (rows @ pivots.T)))
    return distance <= distance.min(axis=1, keepdims=True) + 2.0 * reach + SLACK


def _with_cells(df: DataFrame, pivots: np.ndarray, reach: float | None) -> DataFrame:
    """Add ``_cell``: the nearest pivot, or with ``reach`` every cell within it."""
    schema = T.StructType([*df.schema.fields, T.StructField("_cell", T.IntegerType())])

    def assign(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if table.num_rows == 0:
                continue
            rows = unit_rows(table["_vec"])
            if reach is None:
                distance = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (rows @ pivots.T)))
                row, cell = np.arange(table.num_rows), distance.argmin(axis=1)
            else:
                row, cell = np.nonzero(_visited(rows, pivots, reach))
            out = table.take(pa.array(row)).append_column("_cell", pa.array(cell.astype(np.int32)))
            yield from out.to_batches()

    return df.mapInArrow(assign, schema)


def block_grid(
    left: DataFrame, right: DataFrame, keys: Sequence[str], left_id: str, right_id: str, left_rows: int, right_rows: int, right_blocks: int = 1
) -> tuple[DataFrame, DataFrame, list[str]]:
    """Cut both sides of a keyed join into blocks of about the given sizes.

    Every row of one side is copied once per block of the other, so that the
    returned block columns pair every left with every right row of a key
    exactly once, a bounded number at a time.  The right side of a key is cut
    into ``right_blocks`` at least, while these hold LEAST_QUERIES rows.
    """

    def sizes(df: DataFrame, rows: int, name: str, least: int = 1) -> DataFrame:
        n = F.count("*")
        blocks = F.greatest(F.ceil(n / rows), F.least(F.ceil(n / LEAST_QUERIES), F.lit(least)))
        return df.groupBy(*keys).agg(blocks.cast("int").alias(name))

    grid = sizes(left, left_rows, "_nl").join(sizes(right, right_rows, "_nr", right_blocks), list(keys))

    def spread(df: DataFrame, own: str, count: str, other: str, other_count: str, key: str) -> DataFrame:
        return (
            df.join(grid, list(keys))
            .withColumn(own, F.pmod(F.xxhash64(key), F.col(count)).cast("int"))
            .withColumn(other, F.explode(F.sequence(F.lit(0), F.col(other_count) - 1)))
            .drop("_nl", "_nr")
        )

    return (
        spread(left, "_lb", "_nl", "_rb", "_nr", left_id),
        spread(right, "_rb", "_nr", "_lb", "_nl", right_id),
        [*keys, "_lb", "_rb"],
    )


def _search(
    queries: DataFrame,
    units: DataFrame,
    threshold: float,
    k: int | None,
    keys: Sequence[str],
    query_id: str,
    unit_id: str,
    per: str | None,
    pairs: bool,
    rows_per_block: int,
    query_blocks: int,
) -> DataFrame:
    # fresh attributes on both sides: queries and units may be the same table
    own_keys = [F.col(key).alias(key) for key in keys]
    left = units.filter(F.col("embedding").isNotNull()).select(
        *own_keys, F.col(unit_id).alias("_uid"), F.col("embedding").alias("_vec"), *([F.col(per).alias(per)] if per else [])
    )
    right = queries.filter(F.col("embedding").isNotNull()).select(
        *own_keys, F.col(query_id).alias("_qid"), F.col("embedding").alias("_vec")
    )
    cells = list(keys)
    if threshold >= PRUNE_FROM:
        reach = float(np.sqrt(max(0.0, 2.0 - 2.0 * threshold)))
        pivots = _pivot_rows(left, reach)
        if len(pivots):
            left, right = _with_cells(left, pivots, None), _with_cells(right, pivots, reach)
            cells.append("_cell")

    left, right, blocks = block_grid(left, right, cells, "_uid", "_qid", rows_per_block, rows_per_block, query_blocks)
    fields = [
        T.StructField("_qid", right.schema["_qid"].dataType),
        T.StructField("_uid", left.schema["_uid"].dataType),
        T.StructField("similarity", T.DoubleType()),
    ]
    if per:
        fields.append(T.StructField(per, left.schema[per].dataType))
    schema = T.StructType(fields)
    kernel = _block_search(threshold, k, pairs, per, to_arrow_schema(schema))
    # both sides of a pair of blocks are one group, so that what is found can leave the kernel bit by bit
    left, right = left.withColumn("_asks", F.lit(False)), right.withColumn("_asks", F.lit(True))
    if left.schema["_vec"].dataType != right.schema["_vec"].dataType:
        left, right = (side.withColumn("_vec", F.col("_vec").cast("array<double>")) for side in (left, right))
    return left.unionByName(right, allowMissingColumns=True).groupBy(*blocks).applyInArrow(kernel, schema)


def nearest_few(
    queries: DataFrame, units: DataFrame, threshold: float, k: int, keys: Sequence[str] = ("bank_id",), query_id: str = "query_id", unit_id: str = "unit_id"
) -> DataFrame:
    """As ``nearest``, for stored queries.  If they are at most FEW_QUERIES, they go to the units, which are not shuffled."""
    own = [F.col(key).alias(key) for key in keys]
    right = queries.filter(F.col("embedding").isNotNull()).select(*own, F.col(query_id).alias("_qid"), F.col("embedding").cast("array<double>").alias("_vec"))
    few = right.limit(FEW_QUERIES + 1).toArrow()
    if few.num_rows > FEW_QUERIES:
        return nearest(queries, units, threshold, k, keys, query_id, unit_id)
    left = units.filter(F.col("embedding").isNotNull()).select(*own, F.col(unit_id).alias("_uid"), F.col("embedding").cast("array<double>").alias("_vec"))
    schema = T.StructType([right.schema["_qid"], left.schema["_uid"], T.StructField("similarity", T.DoubleType())])
    arrow = to_arrow_schema(schema)
    kernel = _block_search(threshold, k, False, None, arrow)
    asked = {}
    for i, key in enumerate(zip(*[few[key].to_pylist() for key in keys])):
        asked.setdefault(key, []).append(i)
    # a null key equals none
    asked = {key: few.select(["_qid", "_vec"]).take(pa.array(at)) for key, at in asked.items() if None not in key}

    def sides(held: pa.Table, wanted: pa.Table) -> Iterator[pa.RecordBatch]:
        n, m = held.num_rows, wanted.num_rows
        one = {"_uid": held["_uid"], "_qid": pa.nulls(n, wanted.schema.field("_qid").type), "_vec": held["_vec"], "_asks": pa.array([False] * n)}
        two = {"_uid": pa.nulls(m, held.schema.field("_uid").type), "_qid": wanted["_qid"], "_vec": wanted["_vec"], "_asks": pa.array([True] * m)}
        yield from (batch for part in (one, two) for batch in pa.table(part).to_batches())

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def met() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held)
            mine: dict[tuple, list[int]] = {}
            for i, key in enumerate(zip(*[table[key].to_pylist() for key in keys])):
                mine.setdefault(key, []).append(i)
            for key, at in mine.items():
                if key in asked:
                    yield from kernel(sides(table.take(pa.array(at)), asked[key]))

        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= UNITS_PER_STEP:
                yield from met()
                held, size = [], 0
        if size:
            yield from met()

    found = left.mapInArrow(search, schema)
    return _named(top(found, ["_qid"], [F.desc("similarity"), F.asc("_uid")], k), query_id, unit_id)


def nearest(
    queries: DataFrame,
    units: DataFrame,
    threshold: float,
    k: int,
    keys: Sequence[str] = ("bank_id",),
    query_id: str = "query_id",
    unit_id: str = "unit_id",
    per: str | None = None,
    exclude_self: bool = False,
    rows_per_block: int = ROWS_PER_BLOCK,
    query_blocks: int = QUERY_BLOCKS,
) -> DataFrame:
    """(query, unit, similarity, rn): the k most similar units of each query.

    Only units of the query's ``keys`` with similarity >= threshold count;
    with ``per`` the k apply to each value of that column separately.  Ties go
    to the smaller unit id.
    """
    found = _search(queries, units, threshold, k, keys, query_id, unit_id, per, exclude_self, rows_per_block, query_blocks)
    ranked = top(found, ["_qid", *([per] if per else [])], [F.desc("similarity"), F.asc("_uid")], k)
    return _named(ranked, query_id, unit_id)


def above(
    queries: DataFrame,
    units: DataFrame,
    threshold: float,
    keys: Sequence[str] = ("bank_id",),
    query_id: str = "query_id",
    unit_id: str = "unit_id",
    exclude_self: bool = False,
    rows_per_block: int = ROWS_PER_BLOCK,
    query_blocks: int = QUERY_BLOCKS,
) -> DataFrame:
    """(query, unit, similarity): every pair at or above the threshold."""
    found = _search(queries, units, threshold, None, keys, query_id, unit_id, None, exclude_self, rows_per_block, query_blocks)
    return _named(found, query_id, unit_id)


def _named(found: DataFrame, query_id: str, unit_id: str) -> DataFrame:
    return found.withColumnRenamed("_qid", query_id).withColumnRenamed("_uid", unit_id)


def similar_pairs(
    units: DataFrame, threshold: float, keys: Sequence[str] = ("bank_id",), unit_id: str = "unit_id"
) -> DataFrame:
    """(a, b, similarity) with a < b for every pair of one key above the threshold."""
    left, right = units.withColumnRenamed(unit_id, "a"), units.withColumnRenamed(unit_id, "b")
    return above(left, right, threshold, keys, "a", "b", True).filter(F.col("a") < F.col("b"))

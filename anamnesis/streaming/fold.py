"""A keyed, ordered fold over a stream with state kept by Spark."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

Step = Callable[[dict, Any], list[tuple]]


def keyed_fold(
    stream: DataFrame, key: str, order: list[str], step: Step, start: Callable[[], dict], schema: str
) -> DataFrame:
    """Rows ``step(state, row)`` gives for every row of a key, in order.

    The state is one small JSON value per key.  Rows are ordered inside a
    micro-batch, whose size the source bounds (maxFilesPerTrigger, or its like);
    a row that arrives a batch too late meets the later state and it is up to
    ``step`` to ignore it.
    """
    columns = [part.strip().split()[0] for part in schema.split(",")]

    def fold(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        current = json.loads(state.get[0]) if state.exists else start()
        rows = pd.concat(list(batches)).sort_values(order, kind="stable")
        found = [(group[0], *out) for row in rows.itertuples(index=False) for out in step(current, row)]
        state.update((json.dumps(current),))
        yield pd.DataFrame(found, columns=columns)

    return stream.groupBy(key).applyInPandasWithState(
        fold, schema, "state string", "append", GroupStateTimeout.NoTimeout
    )


def run_to_end(stream: DataFrame, path: str) -> DataFrame:
    """Process what is there, exactly once, into files below ``path``."""
    writer = stream.writeStream.format("parquet").outputMode("append").trigger(availableNow=True)
    query = writer.option("checkpointLocation", f"{path}/checkpoint").option("path", f"{path}/rows").start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/rows")

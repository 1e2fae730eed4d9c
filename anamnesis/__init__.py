"""Conversational-memory analytics on Spark DataFrames.

Every operator takes and returns DataFrames; a query is a row of a table, so
one job answers any number of queries.  Wall-clock time is never read: rules
that depend on "now" take an explicit ``as_of``.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle

# Arrow kernels travel to the executors inside the task closure, so a cluster
# needs no copy of this package on its workers.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"

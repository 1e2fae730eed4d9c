"""The registered queries: each one a DataFrame builder and, where SQL can say it, its SQL twin."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from anamnesis.catalog.fixtures import Tables, with_views


@dataclass(frozen=True)
class Entry:
    build: Callable[[Tables], DataFrame]
    sql: str | None


REGISTRY: dict[str, Entry] = {}


def query(name: str, sql: str | None = None, views: tuple[str, ...] = ()):
    """Register the decorated builder under ``name``."""

    def add(build: Callable[[Tables], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"query {name} is registered twice")
        REGISTRY[name] = Entry(build, with_views(sql, views) if sql else None)
        return build

    return add

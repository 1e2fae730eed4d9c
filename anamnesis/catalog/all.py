"""Importing this module registers every query."""

from anamnesis.catalog import REGISTRY
from anamnesis.catalog import chat as _chat  # noqa: F401
from anamnesis.catalog import functions as _functions  # noqa: F401
from anamnesis.catalog import graph as _graph  # noqa: F401
from anamnesis.catalog import memory as _memory  # noqa: F401
from anamnesis.catalog import search as _search  # noqa: F401
from anamnesis.catalog import streams as _streams  # noqa: F401
from anamnesis.catalog.fixtures import Tables

__all__ = ["REGISTRY", "Tables"]

"""What can be plugged in: embedders and rerankers by name, candidate sources, and a cache of results by key."""

from __future__ import annotations

import time
from collections import OrderedDict
from collections.abc import Callable
from typing import Any, Protocol

from pyspark.sql import Column, DataFrame

from lodeweave.functions.vectors import DIMENSIONS, embed


class Embedder(Protocol):
    """Text columns to vector columns, for documents and for queries."""

    def embed(self, text: Column) -> Column: ...

    def embed_query(self, text: Column) -> Column: ...


class MatchSource(Protocol):
    """A source of candidates for a window of moments."""

    def candidates(self, window: DataFrame) -> DataFrame: ...


class HashingEmbedder:
    """The embedder that needs no model."""

    def __init__(self, dimensions: int = DIMENSIONS):
        self.dimensions = dimensions

    def embed(self, text: Column) -> Column:
        return embed(text, self.dimensions)

    embed_query = embed


_EMBEDDERS: dict[str, Callable[[], Embedder]] = {"hashing": HashingEmbedder}


def register_embedder(name: str, make: Callable[[], Embedder]) -> None:
    _EMBEDDERS[name] = make


def embedder(name: str = "hashing") -> Embedder:
    """The embedder of a name; an unknown one is an error, not a default."""
    if name not in _EMBEDDERS:
        raise ValueError(f"no embedder {name!r}; there are {sorted(_EMBEDDERS)}")
    return _EMBEDDERS[name]()


def choose_model(override: str | None, language: str | None, evidence: dict[str, str]) -> str:
    """The model to use: what is asked for, else what evidence says for the corpus's language, else the default."""
    return override or evidence.get(language or "") or "hashing"


class ResultCache:
    """DataFrames by key, the least recently used going first, none older than ttl seconds."""

    def __init__(self, size: int = 128, ttl: float = 600.0, clock: Callable[[], float] = time.monotonic):
        self.size, self.ttl, self.clock = size, ttl, clock
        self.entries: OrderedDict[str, tuple[float, Any]] = OrderedDict()
        self.hits = self.misses = 0

    def get(self, key: str) -> Any | None:
        found = self.entries.get(key)
        if found is None or self.clock() - found[0] > self.ttl:
            self.entries.pop(key, None)
            self.misses += 1
            return None
        self.entries.move_to_end(key)
        self.hits += 1
        return found[1]

    def put(self, key: str, value: Any) -> None:
        self.entries[key] = self.clock(), value
        self.entries.move_to_end(key)
        while len(self.entries) > self.size:
            self.entries.popitem(last=False)

"""Texts to vectors by a pluggable model, in batches; queries through a small cache on the driver."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import is_usable, layer_norm_slice

# Fixed values.
CLAMP_CHARS, DOCUMENT_PREFIX, QUERY_PREFIX, CACHED_QUERIES, FULL_WIDTH = 1800, "search_document: ", "search_query: ", 128, 768

Model = Callable[[Sequence[str]], Sequence[Sequence[float]]]


def embedded(chunks: DataFrame, model: Model, width: int, batch: int = 2, pause: float = 0.0, text: str = "embedded") -> DataFrame:
    """id, hash, vector of chunks; vectors of wrong width or with entries that aren't finite are dropped.

    ``model`` gets ``batch`` prefixed texts at a time and is built once a worker if it is a class of callables.
    """

    def run(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in it:
            out: list = []
            for at in range(0, len(texts), batch):
                out += [list(map(float, v)) for v in model([DOCUMENT_PREFIX + (t or "")[:CLAMP_CHARS] for t in texts[at : at + batch]])]
                if pause:
                    time.sleep(pause)
            yield pd.Series(out)

    vector = F.pandas_udf(run, "array<float>")(text)
    d = chunks.select("id", "hash", vector.alias("v"))
    return d.withColumn("vector", layer_norm_slice(F.col("v"), width).cast("array<float>")).where(is_usable(F.col("vector"), width)).drop("v")


class QueryEmbedder:
    """Query vectors, the last ``CACHED_QUERIES`` kept; ``reconfigure`` forgets them."""

    def __init__(self, model: Model) -> None:
        self.reconfigure(model)

    def reconfigure(self, model: Model) -> None:
        self.model = model
        self._cached = lru_cache(maxsize=CACHED_QUERIES)(lambda text: tuple(map(float, model([QUERY_PREFIX + text[:CLAMP_CHARS]])[0])))

    def __call__(self, text: str) -> tuple[float, ...]:
        return self._cached(text)

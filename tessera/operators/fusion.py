"""Reciprocal-rank fusion of a lexical and a vector ranking."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bm25, vector


def rrf_constant(k: float | None) -> int:
    """The constant, from 1 to 200; 60 by default. NaN is refused."""
    if k is None:
        return 60
    if math.isnan(k):
        raise ValueError("the fusion constant is not a number")
    return int(max(1, min(math.floor(k) if math.isfinite(k) else (200 if k > 0 else 1), 200)))


def result_limit(asked: int | None, default: int = 5) -> int:
    return max(1, min(int(asked if asked is not None else default), 15))


def fuse(lexical: DataFrame, semantic: DataFrame, k: float | None = None, limit: int | None = None) -> DataFrame:
    """id, rrf, bm25_score, sim, bm25_rank, vector_rank, signal, matches.

    Ties go by lexical rank, those without one last, then by vector rank.
    """
    c = rrf_constant(k)
    part = lambda r: F.coalesce(F.lit(1.0) / (F.lit(c) + F.col(r)), F.lit(0.0))
    both = lexical.join(semantic, "id", "full_outer").select(
        "id", (part("bm25_rank") + part("vector_rank")).alias("rrf"), F.coalesce("score", F.lit(0.0)).alias("bm25_score"), F.coalesce("sim", F.lit(0.0)).alias("sim"), "bm25_rank", "vector_rank",
        F.when(F.col("bm25_rank").isNotNull() & F.col("vector_rank").isNotNull(), "hybrid").when(F.col("vector_rank").isNotNull(), "semantic").otherwise("lexical").alias("signal"),
        F.coalesce("matches", F.array().cast("array<string>")).alias("matches"),
    )
    if limit is None:
        return both
    return both.orderBy(F.col("rrf").desc(), F.col("bm25_rank").asc_nulls_last(), F.col("vector_rank").asc_nulls_last()).limit(limit)


def hybrid_search(toks: DataFrame, query: str, vectors: DataFrame | None = None, query_vector: DataFrame | None = None, profile: str = "hybrid", keep: Column | None = None, k: float | None = None, limit: int = 5, threshold: float = vector.THRESHOLD) -> DataFrame:
    """Both legs under one filter, fused. ``off`` finds nothing; ``lean``, or no vectors, is the lexical leg alone."""
    lexical = bm25.search(toks, query, limit=0 if profile == "off" else vector.DEPTH, keep=keep)
    if profile in ("off", "lean") or vectors is None or query_vector is None:
        semantic = lexical.limit(0).select("id", F.lit(0.0).alias("sim"), F.lit(0).alias("vector_rank"))
    else:
        kept = vectors if keep is None else vectors.join(toks.where(keep).select("id"), "id", "left_semi")
        semantic = vector.search(kept, query_vector, threshold)
    return fuse(lexical, semantic, k, limit)

"""Exact vector search by dot product of unit vectors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import dot, is_usable

THRESHOLD, DEPTH = 0.55, 100


def is_ready(vectors: DataFrame, n_chunks: DataFrame, width: int, vector_col: str = "vector") -> DataFrame:
    """One row: whether every chunk has a usable vector and there is one at least. ``n_chunks``: one row, n."""
    counted = vectors.agg(F.count("*").alias("nvectors"), F.count_if(is_usable(F.col(vector_col), width)).alias("usable"))
    return counted.crossJoin(F.broadcast(n_chunks.select("n"))).select("nvectors", "usable", F.col("n").alias("nchunks"), ((F.col("nvectors") == F.col("n")) & (F.col("usable") == F.col("n")) & (F.col("n") > 0)).alias("ready"))


def search(vectors: DataFrame, query: DataFrame, threshold: float = THRESHOLD, depth: int = DEPTH, vector_col: str = "vector") -> DataFrame:
    """id, sim, vector_rank: those of ``threshold`` at least, the best ``depth``. ``query``: one row, q."""
    scored = vectors.crossJoin(F.broadcast(query.select("q").limit(1))).select("id", dot(F.col(vector_col), F.col("q")).alias("sim")).where(F.round("sim", 9) >= threshold)
    best = scored.orderBy(F.round("sim", 6).desc(), "id").limit(depth)
    return best.withColumn("vector_rank", F.row_number().over(Window.orderBy(F.round("sim", 6).desc(), "id")).cast("int"))


def search_many(vectors: DataFrame, queries: DataFrame, threshold: float = THRESHOLD, depth: int = DEPTH, most_queries: int = 1000) -> DataFrame:
    """qid, id, sim, rank for a stated set of queries (qid, q), dealt by a hash in blocks of about ``most_queries``.

    A block is broadcast, so its size has a bound; each block is one pass over the vectors. Ranks are cut to ``depth`` in
    each task before they are shuffled.
    """
    blocks = max(1, -(-queries.count() // most_queries))
    block = F.pmod(F.xxhash64("qid"), F.lit(blocks))
    part = lambda n: vectors.crossJoin(F.broadcast(queries.where(block == n))).select("qid", "id", dot(F.col("vector"), F.col("q")).alias("sim")).where(F.round("sim", 9) >= threshold)
    order = Window.partitionBy("qid").orderBy(F.round("sim", 6).desc(), "id")
    best = lambda d: d.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= depth)
    return reduce(DataFrame.unionByName, (best(part(n)) for n in range(blocks)))

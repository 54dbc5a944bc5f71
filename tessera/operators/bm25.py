"""Okapi BM25 over an inverted index of DataFrames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import query_terms, tokens
from ..functions.vectors import let
from ..sources.tables import staged

K1, B = 1.2, 0.75


@dataclass(frozen=True)
class Index:
    """postings (term, id, tf), lengths (id, dl), frequencies (term, df) and stats (ndocs, avgdl), one row."""

    postings: DataFrame
    lengths: DataFrame
    frequencies: DataFrame
    stats: DataFrame


def tokenised(docs: DataFrame, text: Column | str = "content", id_col: str = "id", *more: str) -> DataFrame:
    """id, toks and the columns of ``more``. Ids are taken to be unique; ``one_row_an_id`` makes them so."""
    return docs.select(F.col(id_col).alias("id"), tokens(text).alias("toks"), *more)


def one_row_an_id(docs: DataFrame, id_col: str = "id") -> DataFrame:
    """Of rows of equal id the largest. It shuffles whole rows: for sources that may hold an id twice."""
    rest = [c for c in docs.columns if c != id_col]
    return docs.groupBy(id_col).agg(F.max(F.struct(*rest)).alias("row")).select(id_col, "row.*")


def doc_lengths(toks: DataFrame) -> DataFrame:
    return toks.select("id", F.size("toks").cast("long").alias("dl"))


def postings(toks: DataFrame) -> DataFrame:
    return toks.select("id", F.explode("toks").alias("term")).groupBy("term", "id").agg(F.count("*").alias("tf"))


def doc_frequencies(posted: DataFrame) -> DataFrame:
    return posted.groupBy("term").agg(F.count("*").alias("df"))


def corpus_stats(lengths: DataFrame) -> DataFrame:
    return lengths.agg(F.count("*").alias("ndocs"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avgdl"))


def build_index(toks: DataFrame) -> Index:
    """From tokens that were written before, so that they are made once."""
    posted, lengths = postings(toks), doc_lengths(toks)
    return Index(posted, lengths, doc_frequencies(posted), corpus_stats(lengths))


def idf(ndocs: Column, df: Column) -> Column:
    return F.log(F.lit(1.0) + (ndocs - df + F.lit(0.5)) / (df + F.lit(0.5)))


def tf_norm(tf: Column, dl: Column, avgdl: Column) -> Column:
    length = F.when(dl == 0, avgdl).otherwise(dl.cast("double"))
    return tf * F.lit(K1 + 1) / (tf + F.lit(K1) * (F.lit(1 - B) + F.lit(B) * (length / F.when(avgdl == 0, F.lit(1.0)).otherwise(avgdl))))


def _summed(parts: Column) -> Column:
    """Sum in the order of the query's terms, so that the last bit is the same every time."""
    return F.aggregate(parts, F.lit(0.0), lambda a, x: a + x["s"])


def scored(toks: DataFrame, query: str, keep: Column | None = None) -> DataFrame:
    """id, score, matches of every hit. ``toks``: id, toks and what ``keep`` needs.

    ``keep`` filters what is scored and nothing else: counts and lengths are of all documents. The query's terms are
    known, so their counts are taken row by row in one scan and staged, and nothing is shuffled but one row of sums and
    the best.
    """
    terms = query_terms(query)
    if not terms:
        return toks.sparkSession.createDataFrame([], f"id {toks.schema['id'].dataType.simpleString()}, score double, matches array<string>")
    n = len(terms)
    # one value a row that everything is taken from: tokens are made once, and what is kept of them is a few numbers
    count = lambda ts: F.struct(F.size(ts).cast("long").alias("dl"), *(F.size(F.filter(ts, _is(t))).alias(f"tf{i}") for i, t in enumerate(terms)))
    kept = F.lit(True) if keep is None else F.coalesce(keep, F.lit(False))
    counted = staged(toks.select("id", kept.alias("kept"), let(F.col("toks"), count).alias("n")).select("id", "kept", "n.*"), "counted")
    stats = counted.agg(F.count("*").alias("ndocs"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avgdl"), *(F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(n)))
    hits = counted.where(F.col("kept") & (F.greatest(*(F.col(f"tf{i}") for i in range(n)), F.lit(0)) > 0))
    part = lambda i: F.when(F.col(f"tf{i}") > 0, F.struct(F.lit(terms[i]).alias("t"), (idf(F.col("ndocs"), F.col(f"df{i}")) * tf_norm(F.col(f"tf{i}"), F.col("dl"), F.col("avgdl"))).alias("s")))
    parts = F.array_compact(F.array(*(part(i) for i in range(n))))
    return hits.crossJoin(F.broadcast(stats)).select("id", parts.alias("parts")).select("id", _summed(F.col("parts")).alias("score"), F.transform("parts", lambda x: x["t"]).alias("matches"))


def search(toks: DataFrame, query: str, limit: int = 50, keep: Column | None = None) -> DataFrame:
    """id, score, matches, bm25_rank: the best ``limit``."""
    return ranked(scored(toks, query, keep), limit)


def _is(term: str):
    return lambda x: x == term


def ranked(hits: DataFrame, limit: int, score: str = "score", rank: str = "bm25_rank") -> DataFrame:
    """Best first by the score to six places, then by id."""
    best = hits.orderBy(F.round(score, 6).desc(), "id").limit(max(0, limit))
    return best.withColumn(rank, F.row_number().over(Window.orderBy(F.round(score, 6).desc(), "id")).cast("int"))


def search_index(index: Index, query: str, limit: int = 50, keep: DataFrame | None = None) -> DataFrame:
    """The same over a stored index: only the postings of the query's terms are read. ``keep``: ids to score."""
    terms = query_terms(query)
    spark = index.postings.sparkSession
    asked = spark.createDataFrame([(t, i) for i, t in enumerate(terms)], "term string, pos int")
    wanted = index.postings.where(F.col("term").isin(*terms) if terms else F.lit(False))
    frequent = index.frequencies.where(F.col("term").isin(*terms) if terms else F.lit(False))
    joined = wanted.join(F.broadcast(asked), "term").join(F.broadcast(frequent), "term").join(index.lengths, "id").crossJoin(F.broadcast(index.stats))
    if keep is not None:
        joined = joined.join(keep.select("id").distinct(), "id", "left_semi")
    part = F.struct("pos", (idf(F.col("ndocs"), F.col("df")) * tf_norm(F.col("tf"), F.col("dl"), F.col("avgdl"))).alias("s"), F.col("term").alias("t"))
    found = joined.groupBy("id").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    return ranked(found.select("id", _summed(F.col("parts")).alias("score"), F.transform("parts", lambda x: x["t"]).alias("matches")), limit)


def updated(index: Index, removed: DataFrame, added: DataFrame) -> Index:
    """The index after the ids of ``removed`` went and the tokens of ``added`` (id, toks) came; added ids replace old ones.

    Counts move by what went and came: nothing of the rest is counted again.
    """
    gone = removed.select("id").union(added.select("id")).distinct()
    left = index.postings.join(gone, "id", "left_anti")
    new = postings(added)
    posted = left.unionByName(new)
    change = index.postings.join(gone, "id", "left_semi").select("term", F.lit(-1).alias("d")).unionByName(new.select("term", F.lit(1).alias("d")))
    moved = index.frequencies.select("term", F.col("df").alias("d")).unionByName(change.select("term", F.col("d").cast("long").alias("d"))).groupBy("term").agg(F.sum("d").alias("df")).where("df > 0")
    lengths = index.lengths.join(gone, "id", "left_anti").unionByName(doc_lengths(added))
    return Index(posted, lengths, moved, corpus_stats(lengths))

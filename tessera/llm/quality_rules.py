"""Operator 7: quality rules and a hashed n-gram log-likelihood ratio.

Byte n-grams are hashed into ``buckets`` counts, once over all documents (raw corpus) and once over the trusted ones.
A document's score is the mean, over its n-grams, of log p(trusted) - log p(raw), so length doesn't matter. The
threshold is the score below which only ``trusted_loss`` of the trusted documents lie, less ``slack``: the same rows
always give the same verdicts, and each document gets one.

Counts and threshold cover every document. Which documents are trusted comes from a join with the labels; the threshold
is exact, found among the trusted scores by ever narrower histograms.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import frugal, materialise, text_bytes

NGRAM, BUCKETS = 4, 1 << 14
# The symbols of the rule, and what is no code point of a word (white space and UTF-8 continuation bytes).
SYMBOLS = b"#*$%&|<>"
NOT_COUNTED = b" \t\n\x0b\x0c\r" + bytes(range(0x80, 0xC0))
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated(words: list[bytes]) -> int:
    """Words in 3-word windows that stand in the text twice or more."""
    if len(words) < 4:
        return 0
    numbers = {w: i for i, w in enumerate(dict.fromkeys(words))}
    at, n = np.array(list(map(numbers.__getitem__, words)), dtype=np.int64), len(numbers)
    pairs = at[:-2] * n + at[1:-1]
    if n >= 1 << 20:  # else a window's number would not fit
        pairs = np.unique(pairs, return_inverse=True)[1]
    windows = pairs * n + at[2:]
    order = np.argsort(windows, kind="stable")
    equal = windows[order[1:]] == windows[order[:-1]]
    if not equal.any():
        return 0
    twice = np.zeros(len(windows), dtype=bool)
    twice[order[1:][equal]] = twice[order[:-1][equal]] = True
    covered = np.zeros(len(words), dtype=bool)
    for j in range(3):
        covered[j : j + len(windows)] |= twice
    return int(covered.sum())


def rule_counts(raw: bytes) -> tuple[int, int, int, int, int]:
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return len(words), len(raw.translate(None, NOT_COUNTED)), len(raw) - len(raw.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated(words)


def grams(raw: bytes, buckets: int = BUCKETS) -> np.ndarray:
    """Bucket of each byte n-gram of the text."""
    data = np.frombuffer(raw, dtype=np.uint8).astype(np.uint32)
    if len(data) < NGRAM:
        return np.zeros(0, dtype=np.int64)
    code = data[:-3] | data[1:-2] << np.uint32(8) | data[2:-1] << np.uint32(16) | data[3:] << np.uint32(24)
    code *= np.uint32(0x9E3779B1)
    return (code >> np.uint32(32 - buckets.bit_length() + 1)).astype(np.int64)


def stretches(raw: bytes, size: int = 1 << 20) -> Iterator[bytes]:
    """Parts of a long text that have its n-grams between them, each once."""
    if len(raw) <= size:
        yield raw
        return
    for at in range(0, len(raw) - NGRAM + 1, size):
        yield raw[at : at + size + NGRAM - 1]


def gram_counts(raw: bytes, buckets: int) -> np.ndarray:
    return sum((np.bincount(grams(x, buckets), minlength=buckets) for x in stretches(raw)), np.zeros(buckets, dtype=np.int64))


def trusted_ids(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """doc_id: ids whose every label is 1."""
    good = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.min(F.coalesce(F.col(label_col), F.lit(0))).alias("q"))
    return good.where("q = 1").select("doc_id")


def marked(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` (doc_id and others) with good: whether the id is trusted. Null ids are dealt by their rows.

    Trusted ids grow with the input, so they are never broadcast; the rows of ``docs`` are shuffled once.
    """
    rest = F.xxhash64(*(F.col(c) for c in docs.columns))
    keyed = docs.withColumns({"known": F.col("doc_id").isNotNull(), "key": F.coalesce("doc_id", rest)})
    good = ids.select(F.lit(True).alias("known"), F.col("doc_id").alias("key"), F.lit(True).alias("good")).hint("shuffle_hash")
    return keyed.join(good, ["known", "key"], "left").select(*docs.columns, F.coalesce("good", F.lit(False)).alias("good"))


def at_rank(scores: DataFrame, low: float, high: float, rank: int, most: int = 4096) -> float:
    """The value of a rank (from 0) among s, which lies in [low, high]. ``scores``: s, n (how often)."""
    while True:
        inner = scores.where((F.col("s") >= low) & (F.col("s") <= high))
        if inner.count() <= most:
            for r in sorted(inner.collect(), key=lambda r: r["s"]):
                if rank < r["n"]:
                    return r["s"]
                rank -= r["n"]
        cell = F.least(F.floor((F.col("s") - low) / ((high - low) / most)), F.lit(most - 1))
        found = inner.groupBy(cell.alias("cell")).agg(F.sum("n").alias("n"), F.min("s").alias("low"), F.max("s").alias("high")).collect()
        for r in sorted(found, key=lambda r: r["cell"]):
            if rank < r["n"]:
                low, high = r["low"], r["high"]
                break
            rank -= r["n"]


def percentile(scores: DataFrame, share: float) -> float | None:
    """As SQL's percentile, of all of s, without holding them in one place."""
    counted = materialise(scores.groupBy("s").agg(F.count("*").alias("n")), "trusted_scores")
    whole = counted.agg(F.sum("n").alias("n"), F.min("s").alias("low"), F.max("s").alias("high")).first()
    if not whole["n"]:
        return None
    place = share * (whole["n"] - 1)
    below, above = (at_rank(counted, whole["low"], whole["high"], r) for r in (math.floor(place), math.ceil(place)))
    return below + (place - math.floor(place)) * (above - below)


def fit(docs: DataFrame, ids: DataFrame, buckets: int, trusted_loss: float, slack: float) -> tuple[np.ndarray, float]:
    """Log ratios by bucket and the threshold. ``docs``: doc_id, text. ``ids``: doc_id, the trusted ones."""
    spark = docs.sparkSession

    def count(batches):
        raw_count, good_count = np.zeros(buckets, dtype=np.int64), np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            good = batch.column(0).to_pylist()
            for i, raw in enumerate(text_bytes(batch.column(1))):
                n = gram_counts(raw, buckets)
                raw_count += n
                if good[i]:
                    good_count += n
        at = np.flatnonzero(raw_count)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw_count[at]), pa.array(good_count[at])], names=["b", "raw", "good"])

    raw, good = np.ones(buckets), np.ones(buckets)
    for r in marked(docs, ids).select("good", "text").mapInArrow(frugal(count), "b long, raw long, good long").groupBy("b").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good")).collect():
        raw[r["b"]] += r["raw"]
        good[r["b"]] += r["good"]
    ratio = np.log(good / good.sum()) - np.log(raw / raw.sum())
    if ids.isEmpty():
        return np.zeros(buckets), -np.inf
    model = spark.sparkContext.broadcast(ratio)

    def score(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([mean_ratio(raw, model.value) for raw in text_bytes(batch.column(1))])], names=["doc_id", "s"])

    # scored before the join, so that it moves no texts
    scores = docs.where(F.col("doc_id").isNotNull()).mapInArrow(frugal(score), "doc_id long, s double").join(ids, "doc_id", "left_semi")
    lowest = percentile(scores.select("s"), trusted_loss)
    return ratio, -np.inf if lowest is None else lowest - slack


def mean_ratio(raw: bytes, ratio: np.ndarray) -> float:
    total = count = 0
    for part in stretches(raw):
        at = grams(part, len(ratio))
        total, count = total + float(ratio[at].sum()), count + len(at)
    return total / count if count else 0.0


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id_col: str = "doc_id", label_col: str = "quality", trusted_loss: float = 0.005, slack: float = 0.02, buckets: int = BUCKETS) -> DataFrame:
    """Columns ``row`` (the document's, as a struct), n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, score, kept.

    A null or empty text has no words and fails. Repeated rows count and are judged each on its own. A null id is never
    trusted. Labels of null id or value are no trust; an id labelled both ways is not trusted. Without trusted documents
    every score is 0 and only the rules decide. A score equal to the threshold is kept. An empty table gives no rows. The
    struct keeps columns of any name apart from the new ones. A long text is counted in stretches.
    """
    ids = materialise(trusted_ids(labels, label_id_col, label_col), "trusted")
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ratio, threshold = fit(plain, ids, buckets, trusted_loss, slack)
    model = docs.sparkSession.sparkContext.broadcast((ratio, threshold))
    schema = T.StructType([T.StructField("row", docs.schema), *(T.StructField(c, T.LongType()) for c in COUNTS), T.StructField("base_failed", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("kept", T.BooleanType())])

    at = docs.columns.index(text_col)  # the text goes to Python once, in its row

    def judge(batches):
        for batch in batches:
            ratio, threshold = model.value
            texts = text_bytes(batch.column(0).field(at))
            counts = np.array([rule_counts(x) for x in texts], dtype=np.int64).reshape(-1, 5)
            failed = (counts[:, 0] < 50) | (100 * counts[:, 4] > 50 * counts[:, 0])
            scores = np.array([mean_ratio(x, ratio) for x in texts])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(counts[:, i]) for i in range(5)), pa.array(failed), pa.array(scores), pa.array(~failed & (scores >= threshold))], names=schema.names)

    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")).mapInArrow(frugal(judge), schema)

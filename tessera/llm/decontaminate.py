"""Operator 2: benchmark decontamination by a prefix-filtered set join.

An item's windows are ``window`` consecutive words each (an item of fewer words is one window). A window is a set of placed
shingles: runs of SHINGLE of its words, or all of them if it has fewer. A document contains a window only if it holds all of
its shingles in a row, so one necessary shingle is prefix enough, and the rarest one is taken.

1. The shingles of all windows set bits in a map of at most 2**MAP_BITS bits, however large the benchmark is.
2. One pass over the documents hashes their shingles and looks them up. Length bound: where fewer shingles in a row are in
   the map than a window of that length has, no window can stand. What is left are stretches of words, with their shingles,
   in overlapping parts of bounded length.
3. Shingles of the stretches are counted, each window's are ordered by that count, and its rarest is joined with the
   stretches' (prefix join). Position bounds keep the windows that lie within the stretch, and the words there are compared
   with the window's, one by one.
4. A second pass over the documents joins what was found to each by a digest of its text.

The number of jobs does not depend on the benchmark's size, no window is gathered on the driver, and texts are not
shuffled unless more texts are contaminated than may be broadcast. Equal texts are looked at once after step 2.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import TOKEN_TABLE, frugal, materialise, mix, shingled, text_bytes, token_words, with_one_a_key, word_hashes

SHINGLE = 5
MAP_BITS = 28
STARTS = 32  # starts of windows that travel together
SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())]))
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))


def text_key(raw: bytes) -> bytes:
    return hashlib.blake2b(raw, digest_size=16).digest()


def shingles(words: np.ndarray, length: int) -> np.ndarray:
    """A hash for each place of a window of ``length`` words where one of its shingles may start."""
    g = min(SHINGLE, length)
    if len(words) < g:
        return np.zeros(0, dtype=np.uint64)
    return mix(shingled(words, g) + np.uint64(length))


def stretches(words: np.ndarray, length: int, held) -> list[tuple[int, int, np.ndarray]]:
    """First word, end and shingles of each stretch that may hold windows of ``length`` words, in parts of STARTS starts at
    most. ``held``: of hashes, which may be shingles of a window."""
    need = length - min(SHINGLE, length) + 1
    found = shingles(words, length)
    if len(found) < need:
        return []
    edges = np.flatnonzero(np.diff(held(found).astype(np.int8), prepend=0, append=0))
    out = []
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        for at in range(a, b - need + 1, STARTS):
            end = min(b, at + STARTS + need - 1)
            out.append((at, end - 1 + min(SHINGLE, length), found[at:end]))
    return out


def windows(benchmark: DataFrame, item_col: str, text_col: str, window: int) -> DataFrame:
    """item, x (the window's words, joined), n (how many), tokens (its shingles), one row for each window of each item."""

    def cut(batches):
        for batch in batches:
            for item, raw in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), strict=True):
                words = token_words(raw)
                n = min(window, len(words))
                if not n:
                    continue
                tokens, k = shingles(word_hashes(b" ".join(words))[0][0], n).view(np.int64), n - min(SHINGLE, n) + 1
                for lo in range(0, len(words) - n + 1, 1000):
                    at = range(lo, min(lo + 1000, len(words) - n + 1))
                    yield pa.RecordBatch.from_arrays([pa.array([item] * len(at)), pa.array([b" ".join(words[i : i + n]).decode() for i in at]), pa.array([n] * len(at), pa.int32()), pa.array([tokens[i : i + k] for i in at], pa.list_(pa.int64()))], names=["item", "x", "n", "tokens"])

    rows = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text")).where("item IS NOT NULL AND text IS NOT NULL")
    return rows.mapInArrow(frugal(cut), "item string, x string, n int, tokens array<long>").distinct()


def bit_map(tokens: DataFrame) -> np.ndarray:
    """Bits of the shingles, 64 for each shingle if so many are allowed. What reaches the driver are the map's words."""
    n = tokens.count()
    bits = min(MAP_BITS, max(16, (64 * n).bit_length()))
    slot = F.shiftrightunsigned("token", 64 - bits)
    words = tokens.select(F.shiftright(slot, 6).alias("w"), F.expr(f"shiftleft(1L, CAST(shiftrightunsigned(token, {64 - bits}) & 63L AS INT))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(1 << (bits - 6), dtype=np.uint64)
    out[words.column("w").to_numpy()] = words.column("b").to_numpy().view(np.uint64)
    return out


def candidates(texts: DataFrame, lengths: list[int], bits: np.ndarray) -> DataFrame:
    """key (of the text), n (length of windows), at (first word of the stretch), words, tokens."""
    shared = texts.sparkSession.sparkContext.broadcast(bits)
    shift = np.uint64(64 - (len(bits) * 64 - 1).bit_length())

    def held(hashes):
        at = hashes >> shift
        return (shared.value[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)

    def scan(batches):
        for batch in batches:
            out = []
            for raw in text_bytes(batch.column(0)):
                plain = raw.translate(TOKEN_TABLE)
                (hashes,), starts, ends = word_hashes(plain)
                for length in lengths:
                    for a, b, tokens in stretches(hashes, length, held):
                        out.append((text_key(raw), length, a, [plain[s:e].decode() for s, e in zip(starts[a:b].tolist(), ends[a:b].tolist(), strict=True)], tokens.view(np.int64)))
            types = (pa.binary(), pa.int32(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True) if out else [[]] * 5, types, strict=True)], names=["key", "n", "at", "words", "tokens"])

    return texts.mapInArrow(frugal(scan), "key binary, n int, at long, words array<string>, tokens array<long>")


def merged(hits: DataFrame) -> DataFrame:
    """key, spans: spans that touch or overlap made one. ``hits``: key, start, stop; a text's hits are as many as its words."""

    def merge(batches):
        key, spans, out = None, [], []
        flush = lambda: pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.binary()), pa.array([[{"start": a, "stop": b} for a, b in s] for _, s in out], _SPANS)], names=["key", "spans"])
        for batch in batches:
            for now, start, stop in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now != key:
                    if spans:
                        out.append((key, spans))
                    key, spans = now, [[start, stop]]
                elif start <= spans[-1][1]:
                    spans[-1][1] = max(stop, spans[-1][1])
                else:
                    spans.append([start, stop])
            if len(out) >= 1000:
                yield flush()
                out.clear()
        if spans:
            out.append((key, spans))
        yield flush()

    return hits.repartition("key").sortWithinPartitions("key", "start").mapInArrow(merge, T.StructType([T.StructField("key", T.BinaryType()), T.StructField("spans", SPANS)]))


def _side(df: DataFrame, size: Column, most_bytes: int) -> DataFrame:
    """``df`` to join with, broadcast if its rows' sizes add up to ``most_bytes`` at most."""
    return F.broadcast(df) if (df.agg(F.sum(size)).first()[0] or 0) <= most_bytes else df


def occurrences(texts: DataFrame, benchmark: DataFrame, item_col: str, text_col: str, window: int, most_bytes: int) -> DataFrame:
    """key, spans, items of each text that holds a window, equal texts once. ``texts``: text."""
    every = materialise(windows(benchmark, item_col, text_col, window), "windows")
    lengths = sorted(r["n"] for r in every.select("n").distinct().collect())  # 1 to ``window``
    distinct = every.select("x", "n", "tokens").dropDuplicates(["x", "n"])
    tokens = materialise(distinct.select(F.explode("tokens").alias("token")).distinct(), "tokens")
    found = materialise(candidates(texts, lengths, bit_map(tokens)).dropDuplicates(["key", "n", "at"]), "stretches")
    postings = found.select("key", "n", "at", "words", F.posexplode("tokens").alias("p", "token"))
    counted = materialise(postings.groupBy("token").agg(F.count("*").alias("df")), "counts")
    placed = distinct.select("x", "n", F.posexplode("tokens").alias("o", "token"))
    n_placed = placed.count()
    known = with_one_a_key(placed, placed.groupBy("token").agg(F.count("*").alias("windows")).join(counted, "token"), "token", "windows", n_placed)
    # a shingle that no stretch has rules its window out
    whole = known.groupBy("x", "n").agg(F.count("*").alias("held"), F.min(F.struct("df", "token", "o")).alias("first")).where(F.col("held") == F.col("n") - F.least(F.col("n"), F.lit(SHINGLE)) + 1)
    prefixes = materialise(whole.select(F.col("n").alias("of"), "x", F.split("x", " ").alias("w"), F.col("first.token").alias("token"), F.col("first.o").alias("o")), "prefixes")
    side = _side(prefixes, 2 * F.octet_length("x") + 20 * F.col("of") + 64, most_bytes)
    start = (F.col("p") - F.col("o")).cast("int")
    inside = (F.col("n") == F.col("of")) & (start >= 0) & (start < STARTS) & (start + F.col("of") <= F.size("words"))
    met = postings.join(side, "token").where(inside).where(F.slice("words", start + 1, F.col("of")) == F.col("w"))
    hits = materialise(met.select("key", "x", "of", (F.col("at") + start).alias("start")), "hits")
    spans = merged(hits.select("key", "start", (F.col("start") + F.col("of")).alias("stop")).distinct())
    owners = _side(every.select("x", "item"), F.octet_length("x") + F.octet_length("item") + 64, most_bytes)
    items = hits.select("key", "x").distinct().join(owners, "x").groupBy("key").agg(F.array_sort(F.collect_set("item")).alias("items"))
    return materialise(spans.join(items, "key"), "occurrences")


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, most_bytes: int = 64 << 20) -> DataFrame:
    """Columns ``row`` (the document's, as a struct), ``n_words``, ``spans`` (merged, of words, end exclusive), ``items``
    (ids as strings, sorted, distinct).

    A null or empty document has no words and no hits; items of null id or text, or without words, have no windows; an
    empty benchmark leaves every document clean, an empty table gives no rows. Repeated documents are each a row of the
    result; ids, null or not, are not looked at. Items of equal id count once, and their windows are those of all of them.
    The struct keeps columns of any name apart from the new ones. A long text is one row of a task; a text's spans and
    items are one row of the result, as the caller asked for them.
    """
    texts = docs.select(F.col(text_col).alias("text")).where(F.col("text") != "")
    found = occurrences(texts, benchmark, item_col, item_text_col, window, most_bytes)
    at = docs.columns.index(text_col)
    schema = T.StructType([T.StructField("row", docs.schema), T.StructField("key", T.BinaryType()), T.StructField("n_words", T.LongType())])

    def count(batches):
        for batch in batches:
            raw = text_bytes(batch.column(0).field(at))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([text_key(x) for x in raw], pa.binary()), pa.array([len(token_words(x)) for x in raw], pa.int64())], names=schema.names)

    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")).mapInArrow(frugal(count), schema)
    size = 64 + 16 * F.size("spans") + F.aggregate("items", F.lit(0).cast("long"), lambda a, x: a + F.octet_length(x) + 16)
    told = rows.join(_side(found, size, most_bytes), "key", "left")
    return told.select("row", "n_words", F.coalesce("spans", F.array().cast(SPANS)).alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def digest(found: DataFrame) -> DataFrame:
    """The report of a run: counts of words and items, and a digest of the items' ids."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["stop"] - x["start"])
    return found.select(
        F.col("row.doc_id").alias("doc_id"), "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )

"""Incremental maintenance of an index: what changed, what is reused, what is admitted, what is wrong."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import content_hash, is_known_kind, is_safe_path

# Limits of an admitted corpus.
FILE_BYTES, TOTAL_BYTES, MOST_CHUNKS = 2 * 1024 * 1024, 20 * 1024 * 1024, 10_000


# --- differences -----------------------------------------------------------------------------------------------------
def hashes(files: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    return files.select(F.col(key).alias("path"), content_hash(content).alias("hash"))


def difference(old: DataFrame, new: DataFrame, key: str = "path", value: str = "hash") -> DataFrame:
    """key, old, new, change: added, changed, deleted or same."""
    a, b = old.select(key, F.col(value).alias("old"), F.lit(True).alias("was")), new.select(key, F.col(value).alias("new"), F.lit(True).alias("is"))
    d = a.join(b, key, "full_outer")
    change = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "deleted").when(F.col("old").eqNullSafe(F.col("new")), "same").otherwise("changed")
    return d.select(key, "old", "new", change.alias("change"))


def deleted(old: DataFrame, new: DataFrame, key: str = "path") -> DataFrame:
    return old.select(key).distinct().join(new.select(key), key, "left_anti")


def same_snapshot(old: DataFrame, new: DataFrame, key: str = "path", value: str = "hash") -> DataFrame:
    """One row: how many keys differ, and whether none does."""
    return difference(old, new, key, value).agg(F.count_if(F.col("change") != "same").alias("differing")).withColumn("equal", F.col("differing") == 0)


def lacking_vector(files: DataFrame, chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Files (path) with a chunk (path, id) that has no vector (id)."""
    without = chunks.join(vectors.select("id"), "id", "left_anti")
    return files.join(without, "path", "left_semi").select("path").distinct()


def reused_vectors(new: DataFrame, old: DataFrame, order: str = "seq") -> DataFrame:
    """New chunks (id, hash) with the vector of an old chunk of equal content (hash, vector, seq); the latest one wins."""
    latest = old.groupBy("hash").agg(F.max_by("vector", order).alias("vector"))
    return new.select("id", "hash").join(latest, "hash", "left")


def missing_symbols(wanted: DataFrame, chunks: DataFrame) -> DataFrame:
    """path, covered, missing: what an index lacks of a contract. ``wanted``: path, symbols. ``chunks``: path, symbol."""
    held = chunks.join(wanted.select("path"), "path", "left_semi").groupBy("path").agg(F.collect_set("symbol").alias("held"))
    none = F.array().cast("array<string>")
    d = wanted.join(held, "path", "left")
    return d.select("path", F.col("held").isNotNull().alias("covered"), F.array_sort(F.array_except("symbols", F.coalesce("held", none))).alias("missing"))


def still_valid(vectors: DataFrame, stored: DataFrame, current: DataFrame) -> DataFrame:
    """Vectors (id, vector) whose chunk has the same hash as when they were stored and now."""
    ok = stored.select("id", F.col("hash").alias("was")).join(current.select("id", F.col("hash").alias("now")), "id").where(F.col("was") == F.col("now"))
    return vectors.join(ok.select("id"), "id", "left_semi")


def without_paths(rows: DataFrame, gone: DataFrame, key: str = "path") -> DataFrame:
    """All rows of a path go with it; paths are compared whole, so ``a.ts`` leaves ``a.ts.bak``."""
    return rows.join(gone.select(key).distinct(), key, "left_anti")


def latest(changes: DataFrame, keys: Sequence[str], generation: Sequence[str]) -> DataFrame:
    """The last writer's row of each key, by the columns of ``generation``. It is an aggregate, so a hot key costs no more."""
    rest = [c for c in changes.columns if c not in (*keys, *generation)]
    top = changes.groupBy(*keys).agg(F.max(F.struct(*generation, *rest)).alias("m"))
    return top.select(*keys, *(F.col(f"m.{c}").alias(c) for c in (*generation, *rest)))


def sync_plan(old: DataFrame, new: DataFrame, lacking: DataFrame | None = None, force: bool = False) -> DataFrame:
    """path, action: reindex (forced, new, changed, or a vector is missing), delete, or keep."""
    d = difference(old, new)
    if lacking is not None:
        d = d.join(lacking.select("path", F.lit(True).alias("lacks")), "path", "left")
    else:
        d = d.withColumn("lacks", F.lit(None).cast("boolean"))
    redo = F.lit(force) | F.col("change").isin("added", "changed") | F.coalesce("lacks", F.lit(False))
    return d.select("path", F.when(F.col("change") == "deleted", "delete").when(redo, "reindex").otherwise("keep").alias("action"))


def invalidated(hashed: DataFrame, paths: DataFrame) -> DataFrame:
    """File hashes without those of invalidated paths, so that the next sync reads them again."""
    return without_paths(hashed, paths)


# --- budgets ---------------------------------------------------------------------------------------------------------
def admitted(items: DataFrame, keys: Sequence[str], order: str, size: str, budget: int, count: str | None = None, most: int | None = None) -> DataFrame:
    """``items`` with ``kept``: in order, each is kept if it still fits; one that doesn't is skipped and later ones may.

    What fits depends on all choices before, so a key's items are read in order, one at a time, holding two sums: they are
    sorted, not gathered. Items of equal order go by size and count. A null order comes first, a null size or count never fits.
    """
    n = (F.col(count) if count else F.lit(1)).cast("long")
    row = items.select(F.struct(*(F.col(f"`{c}`") for c in items.columns)).alias("row"), F.struct(*(F.col(k) for k in keys)).alias("k"), F.col(order).alias("o"), F.col(size).cast("long").alias("s"), n.alias("c"))
    schema = T.StructType([T.StructField("row", items.schema), T.StructField("kept", T.BooleanType())])

    def walk(batches):
        key, used, taken = None, 0, 0
        for batch in batches:
            kept = []
            for now, s, c in zip(*(batch.column(i).to_pylist() for i in (1, 3, 4)), strict=True):
                if now != key:
                    key, used, taken = now, 0, 0
                fits = s is not None and c is not None and used + s <= budget and (most is None or taken + c <= most)
                if fits:
                    used, taken = used + s, taken + c
                kept.append(fits)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.bool_())], names=["row", "kept"])

    return row.repartition("k").sortWithinPartitions("k", "o", "s", "c").mapInArrow(walk, schema).select("row.*", "kept")


def retained(files: DataFrame, keys: Sequence[str], mtime: str = "mtime", size: str = "size", most_files: int = 20, most_bytes: int = 50 * 1024 * 1024, tie: str = "name") -> DataFrame:
    """Newest files of each key, as many as both limits allow; the oldest go first.

    Only the ``most_files`` newest of a key can stay, so the window over a key's files stops there.
    """
    w = Window.partitionBy(*keys).orderBy(F.col(mtime).desc(), F.col(tie).desc())
    near = files.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= most_files)
    total = F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return near.withColumn("total", total).where(F.col("total") <= most_bytes).drop("nth", "total")


# --- counts and constraints ------------------------------------------------------------------------------------------
def index_status(files: DataFrame, chunks: DataFrame, vectors: DataFrame, skipped: DataFrame) -> DataFrame:
    """One row: files, skipped, chunks, vectors."""
    n = lambda d, name: d.agg(F.count("*").alias(name))
    return n(files, "files").crossJoin(n(skipped, "skipped")).crossJoin(n(chunks, "chunks")).crossJoin(n(vectors, "vectors"))


def bytes_by_file(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("path").agg(F.count("*").alias("nchunks"), F.sum(F.octet_length("content")).alias("nbytes"))


def violations(chunks: DataFrame, files: DataFrame, manifest: DataFrame | None = None, versions: Sequence[int] = (3, 4), generation: str | None = None) -> DataFrame:
    """rule, n: how many rows break each rule of a snapshot; rules that hold have n 0.

    ``chunks``: id, path, start, stop, symbol, kind, content, hash. ``files``: path, hash. ``manifest``: version, generation.
    """
    joined = F.concat("path", F.lit(":"), F.col("start").cast("string"), F.lit("-"), F.col("stop").cast("string"), F.when(F.length("symbol") > 0, F.concat(F.lit("#"), F.col("symbol"))).otherwise(F.lit("")))
    own = {
        "id_from_parts": F.col("id") != joined,
        "kind": ~is_known_kind("kind"),
        "path": ~is_safe_path("path"),
        "lines": (F.col("start") < 1) | (F.col("stop") < F.col("start")),
        "hash": F.col("hash") != content_hash("content"),
        "hash_format": ~F.col("hash").rlike("^[0-9a-f]{16}$"),
    }
    one = chunks.agg(F.count("*").alias("n"), *(F.count_if(F.coalesce(c, F.lit(True))).alias(k) for k, c in own.items()))
    rows = one.select(F.explode(F.array(*(F.struct(F.lit(k).alias("rule"), F.col(k).alias("n")) for k in own), F.struct(F.lit("most_chunks").alias("rule"), (F.col("n") > MOST_CHUNKS).cast("long").alias("n")))).alias("x")).select("x.*")
    counted = lambda name, d: d.agg(F.count("*").alias("n")).select(F.lit(name).alias("rule"), "n")
    out = rows.unionByName(counted("unique_id", chunks.groupBy("id").count().where("count > 1")))
    out = out.unionByName(counted("known_file", chunks.join(files.select("path"), "path", "left_anti")))
    out = out.unionByName(counted("file_has_chunk", files.join(chunks.select("path"), "path", "left_anti")))
    if manifest is not None:
        bad = ~F.col("version").isin(*versions) | (~F.col("generation").eqNullSafe(F.lit(generation)))
        out = out.unionByName(counted("manifest", manifest.where(bad)))
    return out


def text_matches_source(chunks: DataFrame, sources: DataFrame) -> DataFrame:
    """path, id, fresh: whether a chunk's text is still the slice of its file's lines."""
    d = chunks.join(sources.select("path", F.col("content").alias("source")), "path")
    part = F.array_join(F.slice(F.split("source", "\n", -1), F.col("start").cast("int"), (F.col("stop") - F.col("start") + 1).cast("int")), "\n")
    return d.select("path", "id", (part == F.col("content")).alias("fresh"))


def staleness(chunks: DataFrame, current: DataFrame) -> DataFrame:
    """path, state of each chunk's file: fresh, stale or gone."""
    d = chunks.select("path", "file_hash").distinct().join(current.select("path", F.col("hash").alias("now")), "path", "left")
    return d.select("path", F.when(F.col("now").isNull(), "gone").when(F.col("now") == F.col("file_hash"), "fresh").otherwise("stale").alias("state"))

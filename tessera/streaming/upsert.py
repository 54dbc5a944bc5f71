"""A stream of file changes applied to a chunk index.

The index is a log. A micro-batch adds one delta: the paths it changes, each with its generation (a deletion is a tombstone),
and their new chunks. A path's state is its change of the highest generation, whichever batch brought it, so a late batch
with an old generation changes nothing. Every ``compact_every`` deltas the state is written down as a base, and readers take
the last base and the deltas after it; so a batch costs what it changes, not what the index holds.

A delta or base counts once its commit is there: a one-row file of a new name, never written over. A batch that is run again
after a failure writes the same delta, and one whose commit is there does nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.maintenance import latest, same_snapshot

CHANGE = "path string, generation long, content string"  # a null content deletes the path
_HEADS = "path string, generation long, gone boolean, n long"


@dataclass
class ChunkStore:
    """Chunks by path below ``root``; ``schema`` (of a chunk) has path."""

    spark: SparkSession
    root: str
    schema: str
    compact_every: int = 20

    def commits(self) -> list[tuple[int, bool]]:
        """Number and whether it is a base, of every delta and base, in order."""
        try:
            rows = self.spark.read.schema("n long, base boolean").parquet(f"{self.root}/commits/*").collect()
        except Exception as x:  # the folder isn't there before the first batch
            if "PATH_NOT_FOUND" not in str(x):
                raise
            return []
        return sorted((r["n"], r["base"]) for r in rows)

    def generation(self) -> int:
        return max((n for n, _ in self.commits()), default=-1)

    def _parts(self) -> tuple[DataFrame, DataFrame]:
        """Heads and chunks of the last base and of the deltas after it."""
        done = self.commits()
        base = max((n for n, is_base in done if is_base), default=-1)
        folders = [f"{self.root}/base{base}"] * (base >= 0) + [f"{self.root}/delta{n}" for n, is_base in done if not is_base and n > base]
        empty = lambda schema: self.spark.createDataFrame([], schema)
        read = lambda what, schema: reduce(DataFrame.unionByName, [self.spark.read.schema(schema).parquet(f"{x}/{what}") for x in folders], empty(schema))
        return read("heads", _HEADS), read("chunks", empty(f"{self.schema}, generation long, n long").schema)

    def heads(self) -> DataFrame:
        """path, generation, gone, n (the batch): the change that holds for each path, tombstones too."""
        return latest(self._parts()[0], ["path"], ["generation", "n"])

    def _chunks(self) -> DataFrame:
        live = self.heads().where("NOT gone").select("path", "generation", "n")
        return self._parts()[1].join(live, ["path", "generation", "n"], "left_semi")

    def current(self) -> DataFrame:
        return self._chunks().drop("generation", "n")

    def commit(self, heads: DataFrame, chunks: DataFrame, n: int, base: bool = False) -> None:
        """``heads``: path, generation, gone, n. ``chunks``: those of ``schema``, generation, n."""
        folder = f"{self.root}/{'base' if base else 'delta'}{n}"
        heads.write.mode("overwrite").parquet(f"{folder}/heads")
        chunks.write.mode("overwrite").parquet(f"{folder}/chunks")
        self.spark.createDataFrame([(n, base)], "n long, base boolean").coalesce(1).write.mode("overwrite").parquet(f"{self.root}/commits/{'base' if base else 'delta'}{n}")

    def compact(self) -> None:
        """Write the state down as a base. Older folders are no longer read; they are the caller's to remove."""
        n = self.generation()
        if n >= 0:
            self.commit(self.heads(), self._chunks(), n, base=True)


def apply_changes(store: ChunkStore, changes: DataFrame, chunker: Callable[[DataFrame], DataFrame], n: int) -> None:
    """Add a batch: the last change of each path counts; paths of null content go. A batch that is there already stays.

    ``chunker`` gets path and content and gives rows of the store's schema.
    """
    done = store.commits()
    if n <= max((x for x, _ in done), default=-1):
        return
    last = latest(changes, ["path"], ["generation"])
    heads = last.select("path", "generation", F.col("content").isNull().alias("gone"), F.lit(n).cast("long").alias("n"))
    fresh = chunker(last.where("content IS NOT NULL").select("path", "content")).join(heads.select("path", "generation", "n"), "path")
    store.commit(heads, fresh.select(*store.spark.createDataFrame([], store.schema).columns, "generation", "n"), n)
    since = max((x for x, is_base in done if is_base), default=-1)
    if sum(x > since for x, is_base in done if not is_base) + 1 >= store.compact_every:
        store.compact()


def upserts(changes: DataFrame, store: ChunkStore, chunker: Callable[[DataFrame], DataFrame], checkpoint: str, trigger: dict | None = None):
    """Start the stream. Each micro-batch is one generation; ``processAllAvailable`` flushes before shutdown."""
    start = store.generation() + 1
    writer = changes.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, epoch: apply_changes(store, batch, chunker, start + epoch))
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def synced(spark: SparkSession, attempt: Callable[[], tuple[DataFrame, DataFrame]], most: int = 3) -> DataFrame:
    """The result of ``attempt`` (result, hashes it was made from) once a second look finds the same hashes."""
    for _ in range(most):
        result, before = attempt()
        _, after = attempt()
        if same_snapshot(before, after).first()["equal"]:
            return result
    raise RuntimeError(f"files kept changing over {most} attempts")


def fresh(store_hashes: DataFrame, current: DataFrame) -> DataFrame:
    """One row: whether the index is up to date."""
    return same_snapshot(store_hashes, current)


def searched(search: Callable[[], DataFrame], store_hashes: Callable[[], DataFrame], current: Callable[[], DataFrame], sync: Callable[[], None], most: int = 3) -> DataFrame:
    """The result of ``search`` on an index that is up to date: it is looked at before, and brought up to date if it isn't."""
    for _ in range(most):
        if fresh(store_hashes(), current()).first()["equal"]:
            return search()
        sync()
    raise RuntimeError(f"files kept changing over {most} syncs")


class Job:
    """A tagged piece of work that can be called off, as when the search profile changes."""

    def __init__(self, spark: SparkSession, tag: str) -> None:
        self.spark, self.tag = spark, tag

    def __enter__(self) -> Job:
        self.spark.addTag(self.tag)
        return self

    def __exit__(self, *_) -> None:
        self.spark.removeTag(self.tag)

    def cancel(self) -> list[str]:
        return self.spark.interruptTag(self.tag)


def bursts(events: DataFrame, keys: list[str], ts: str = "ts", gap: str = "500 milliseconds", late: str = "10 seconds") -> DataFrame:
    """Streaming debounce: a burst of a key ends after a quiet gap; late events within ``late`` still count."""
    return events.withWatermark(ts, late).groupBy(F.session_window(ts, gap), *keys).agg(F.min(ts).alias("first"), F.max(ts).alias("last"), F.count("*").alias("n")).select(*keys, "first", "last", "n")

"""Integer intervals: inclusive ranges of lines, counted from 1, by any keys.

Ranges of one key are merged by running maxima over a window, so a key's ranges are sorted together. Where one key may
hold a large share of all rows, ``salted`` merges pieces of it first: pieces shrink to their islands before they meet.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def valid(ranges: DataFrame, total: str | None = None) -> DataFrame:
    """Ranges from 1, not empty, cut at ``total`` lines."""
    d = ranges.where("start >= 1 AND stop >= start")
    if total:
        d = d.withColumn("stop", F.when(F.col(total).isNull(), F.col("stop")).otherwise(F.least("stop", F.col(total)))).where("stop >= start")
    return d


def _merge(ranges: DataFrame, keys: Sequence[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("start")
    before = F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(F.col("before").isNull() | (F.col("start") > F.col("before") + 1), 1).otherwise(0)
    # one row a start: what meets in a window is less, and rows of equal order can't change places between the windows
    d = ranges.groupBy(*keys, "start").agg(F.max("stop").alias("stop")).withColumn("before", before).withColumn("island", F.sum(opens).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("island")


def merge(ranges: DataFrame, keys: Sequence[str], total: str | None = None, salted: int = 0) -> DataFrame:
    """keys, start, stop: overlapping and adjacent ranges as one. ``salted``: width of the stretches merged first."""
    d = valid(ranges, total).select(*keys, "start", "stop")
    if salted:
        d = _merge(d.withColumn("stretch", F.floor(F.col("start") / F.lit(salted))), [*keys, "stretch"]).drop("stretch")
    return _merge(d, keys)


def from_points(points: DataFrame, keys: Sequence[str], point: str = "line") -> DataFrame:
    """keys, start, stop of runs of consecutive numbers, each number once."""
    once = points.where(F.col(point) >= 1).select(*keys, F.floor(F.col(point)).cast("long").alias("p")).distinct()
    run = F.col("p") - F.row_number().over(Window.partitionBy(*keys).orderBy("p"))
    return once.withColumn("run", run).groupBy(*keys, "run").agg(F.min("p").alias("start"), F.max("p").alias("stop")).drop("run")


def union(first: DataFrame, second: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Merged ranges of both sides; columns: keys, start, stop, complete, total. A later total wins."""
    both = first.withColumn("turn", F.lit(1)).unionByName(second.withColumn("turn", F.lit(2)))
    state = both.groupBy(*keys).agg(F.max("complete").alias("complete"), F.max_by("total", F.when(F.col("total").isNotNull(), F.col("turn"))).alias("total"))
    merged = merge(both.drop("total").join(state.select(*keys, "total"), list(keys)).select(*keys, "start", "stop", "total"), keys, "total")
    return merged.join(state, list(keys))


def _in_one(targets: DataFrame, ranges: DataFrame, keys: Sequence[str], start: str, stop: str) -> DataFrame:
    """``targets`` with in: whether a merged range holds the target. A null key is in none.

    Merged ranges lie apart, so only the last that begins at or before the target can hold it: both sides are put in one
    order, and a running last value finds it. No target meets more than one range.
    """
    known = " AND ".join(f"`{k}` IS NOT NULL" for k in keys)
    row = F.struct(*(F.col(f"`{c}`") for c in targets.columns))
    t = targets.select(*keys, F.col(start).cast("long").alias("_at"), F.lit(1).alias("_turn"), F.lit(None).cast("long").alias("_end"), row.alias("_row"))
    r = merge(ranges, keys).where(known).select(*keys, F.col("start").cast("long").alias("_at"), F.lit(0).alias("_turn"), F.col("stop").cast("long").alias("_end"), F.lit(None).cast(t.schema["_row"].dataType).alias("_row"))
    w = Window.partitionBy(*keys).orderBy("_at", "_turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = r.unionByName(t).withColumn("_end", F.last("_end", ignorenulls=True).over(w)).where("_turn = 1")
    return both.select("_row.*", F.coalesce(F.col("_end") >= F.col(f"_row.{stop}"), F.lit(False)).alias("in"))


def covered(targets: DataFrame, ranges: DataFrame, keys: Sequence[str], complete: DataFrame | None = None) -> DataFrame:
    """keys, n_targets, n_covered, ok: every target of a key lies in one merged range, or the key is complete."""
    hit = _in_one(merge(targets, keys), ranges, keys, "start", "stop")
    out = hit.groupBy(*keys).agg(F.count("*").alias("n_targets"), F.count_if("in").alias("n_covered"))
    if complete is None:
        return out.withColumn("ok", F.col("n_targets") == F.col("n_covered"))
    return out.join(complete.select(*keys, "complete"), list(keys), "left").withColumn("ok", F.coalesce("complete", F.lit(False)) | (F.col("n_targets") == F.col("n_covered"))).drop("complete")


def uncovered(targets: DataFrame, ranges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Targets (keys, start, stop) that lie in no range."""
    return _in_one(targets, ranges, keys, "start", "stop").where(~F.col("in")).drop("in")


def overlaps(spans: DataFrame, keys: Sequence[str], id_col: str = "i") -> DataFrame:
    """keys, i, j: the first span that each later one overlaps with, if any; spans inclusive, by start, stop, id.

    It is one row a span at most, found from the running furthest end, not all pairs. ``overlapping_pairs`` has those.
    """
    w = Window.partitionBy(*keys).orderBy("start", "stop", id_col).rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max(F.struct(F.col("stop"), (-F.col(id_col)).alias("neg"))).over(w)
    return spans.withColumn("reach", reach).where(F.col("reach.stop") >= F.col("start")).select(*keys, (-F.col("reach.neg")).alias("i"), F.col(id_col).alias("j"))


def overlapping_pairs(spans: DataFrame, keys: Sequence[str], id_col: str = "i") -> DataFrame:
    """keys, i, j (i < j) of all spans of a key that overlap: for the few edits of a file. Bucketed by nothing else."""
    a, b = spans.alias("a"), spans.alias("b")
    same = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys]
    return a.join(b, [*same, F.col("a.start") <= F.col("b.stop"), F.col("b.start") <= F.col("a.stop"), F.col(f"a.{id_col}") < F.col(f"b.{id_col}")]).select(*(F.col(f"a.{k}") for k in keys), F.col(f"a.{id_col}").alias("i"), F.col(f"b.{id_col}").alias("j"))


def nearest(targets: DataFrame, points: DataFrame, keys: Sequence[str], band: int = 2, target: str = "line", point: str = "hit") -> DataFrame:
    """keys, line, hit, gap: the nearest point within ``band`` of each target, the lower of two as near.

    Points meet targets by stretches of numbers as wide as the band, so it is an equi-join.
    """
    width = max(1, band)
    t = targets.select(*keys, F.col(target).alias("line")).distinct().withColumn("at", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda x: F.floor(F.col("line") / F.lit(width)) + x)))
    p = points.select(*keys, F.col(point).alias("hit")).distinct().withColumn("at", F.floor(F.col("hit") / F.lit(width)))
    both = t.join(p, [*keys, "at"]).withColumn("gap", F.abs(F.col("line") - F.col("hit"))).where(F.col("gap") <= band)
    best = both.groupBy(*keys, "line").agg(F.min(F.struct("gap", "hit")).alias("m"))
    return best.select(*keys, "line", "m.hit", "m.gap")


def shifted(ranges: DataFrame, edits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Ranges after an edit. ``edits``: keys, edit_end (largest end of the edits), delta (lines gained).

    Ranges that begin after the edits move; those before them stay as they are.
    """
    d = ranges.join(edits, list(keys), "left")
    moves = F.col("edit_end").isNotNull() & (F.col("start") > F.col("edit_end"))
    move = lambda c: F.when(moves, F.col(c) + F.col("delta")).otherwise(F.col(c)).alias(c)
    return d.select(*keys, move("start"), move("stop")).where("start >= 1 AND stop >= start")


def edit_summary(edits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, edit_end, delta: from edits with start, stop and n_new (lines put in their place)."""
    return edits.groupBy(*keys).agg(F.max("stop").alias("edit_end"), F.sum(F.col("n_new") - (F.col("stop") - F.col("start") + 1)).alias("delta"))

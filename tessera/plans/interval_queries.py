"""Queries of the interval algebra, over ranges that are worked out from line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import intervals
from ..sources.tables import table
from .registry import query

_R = "r AS (SELECT l_suppkey AS k, l_partkey % 5000 + 1 AS start, l_partkey % 5000 + 1 + l_quantity::BIGINT % 7 AS stop, l_linenumber AS nr, l_partkey % 5000 + 1 AS line FROM lineitem)"
_MERGED = """isle AS (SELECT k, start, stop, sum(CASE WHEN b IS NULL OR start > b + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS g
  FROM (SELECT k, start, stop, max(stop) OVER (PARTITION BY k ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM (SELECT k, start, max(stop) AS stop FROM {0} GROUP BY k, start))),
{1} AS (SELECT k, min(start) AS start, max(stop) AS stop FROM isle GROUP BY k, g)"""


def _ranges(spark, d):
    x = table(spark, d, "lineitem")
    start = F.col("l_partkey") % 5000 + 1
    return x.select(F.col("l_suppkey").alias("k"), start.alias("start"), (start + F.col("l_quantity").cast("long") % 7).alias("stop"), F.col("l_linenumber").alias("nr"), start.alias("line"))


@query("interval_merge", f"WITH {_R}, {_MERGED.format('r', 'm')} SELECT k, start, stop FROM m")
def interval_merge(spark, d):
    return intervals.merge(_ranges(spark, d), ["k"], salted=1000)


@query("points_to_ranges", f"WITH {_R}, p AS (SELECT DISTINCT k, line FROM r), g AS (SELECT k, line, line - row_number() OVER (PARTITION BY k ORDER BY line) AS g FROM p) SELECT k, min(line) AS start, max(line) AS stop FROM g GROUP BY k, g")
def points_to_ranges(spark, d):
    return intervals.from_points(_ranges(spark, d), ["k"])


@query("coverage_check", f"""WITH {_R}, a AS (SELECT k, start, stop FROM r WHERE nr = 1), b AS (SELECT k, start, stop FROM r WHERE nr > 1),
{_MERGED.format('a', 't')}, {_MERGED.replace('isle', 'isle2').format('b', 'm')},
hit AS (SELECT t.k, t.start, coalesce(bool_or(m.start <= t.start AND m.stop >= t.stop), false) AS ok FROM t LEFT JOIN m USING (k) GROUP BY t.k, t.start)
SELECT k, count(*) AS n_targets, count(*) FILTER (ok) AS n_covered, bool_and(ok) AS ok FROM hit GROUP BY k""")
def coverage_check(spark, d):
    r = _ranges(spark, d)
    return intervals.covered(r.where("nr = 1").select("k", "start", "stop"), r.where("nr > 1").select("k", "start", "stop"), ["k"])


@query("uncovered_targets", f"WITH {_R}, b AS (SELECT k, start, stop FROM r WHERE nr > 1), {_MERGED.format('b', 'm')} SELECT k, start, stop FROM r WHERE nr = 1 AND NOT EXISTS (SELECT 1 FROM m WHERE m.k = r.k AND m.start <= r.start AND m.stop >= r.stop)")
def uncovered_targets(spark, d):
    r = _ranges(spark, d)
    return intervals.uncovered(r.where("nr = 1").select("k", "start", "stop"), r.where("nr > 1"), ["k"])


_E = "e AS (SELECT l_orderkey AS k, l_linenumber AS i, l_partkey % 60 + 1 AS start, l_partkey % 60 + 1 + l_quantity::BIGINT % 9 AS stop FROM lineitem)"


def _edits(spark, d):
    start = F.col("l_partkey") % 60 + 1
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("i"), start.alias("start"), (start + F.col("l_quantity").cast("long") % 9).alias("stop"))


@query("overlap_pairs", f"WITH {_E} SELECT a.k, a.i, b.i AS j FROM e a JOIN e b ON a.k = b.k AND a.start <= b.stop AND b.start <= a.stop AND a.i < b.i")
def overlap_pairs(spark, d):
    return intervals.overlapping_pairs(_edits(spark, d), ["k"])


@query("overlapped_edits", f"WITH {_E} SELECT DISTINCT k FROM (SELECT k, start, max(stop) OVER (PARTITION BY k ORDER BY start, stop, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM e) WHERE reach >= start")
def overlapped_edits(spark, d):
    """Keys with overlapping edits, found in one pass."""
    return intervals.overlaps(_edits(spark, d), ["k"]).select("k").distinct()


@query("nearest_hit", f"""WITH {_R}, t AS (SELECT DISTINCT k, line FROM r WHERE nr = 1), h AS (SELECT DISTINCT k, line AS hit FROM r WHERE nr = 2)
SELECT k, line, arg_min(hit, (abs(line - hit), hit)) AS hit, min(abs(line - hit)) AS gap FROM t JOIN h USING (k) WHERE abs(line - hit) <= 2 GROUP BY k, line""")
def nearest_hit(spark, d):
    r = _ranges(spark, d)
    return intervals.nearest(r.where("nr = 1"), r.where("nr = 2").withColumnRenamed("line", "hit"), ["k"])


@query("range_shift", f"""WITH {_R}, b AS (SELECT k, start, stop FROM r WHERE nr > 3), {_MERGED.format('b', 'm')},
s AS (SELECT k, max(stop) AS edit_end, sum(nr - (stop - start + 1)) AS delta FROM r WHERE nr = 3 AND line < 200 GROUP BY k),
x AS (SELECT k, CASE WHEN start > edit_end THEN start + delta ELSE start END AS start, CASE WHEN start > edit_end THEN stop + delta ELSE stop END AS stop FROM m LEFT JOIN s USING (k))
SELECT k, start::BIGINT AS start, stop::BIGINT AS stop FROM x WHERE start >= 1 AND stop >= start""")
def range_shift(spark, d):
    r = _ranges(spark, d)
    edits = intervals.edit_summary(r.where("nr = 3 AND line < 200").withColumn("n_new", F.col("nr")), ["k"])
    return intervals.shifted(intervals.merge(r.where("nr > 3"), ["k"]), edits, ["k"])


@query("coverage_union", f"""WITH {_R}, x AS (SELECT k, start, stop FROM r WHERE nr <= 2), c AS (SELECT k, least(stop, 4000) AS stop, start FROM x WHERE start <= 4000), {_MERGED.format('c', 'm')},
n AS (SELECT k, count(*) FILTER (nr = 2 AND line > 4990) > 0 AS complete FROM r WHERE nr <= 2 GROUP BY k) SELECT k, start, stop, complete FROM m JOIN n USING (k)""")
def coverage_union(spark, d):
    r = _ranges(spark, d).withColumn("complete", (F.col("nr") == 2) & (F.col("line") > 4990)).withColumn("total", F.lit(4000).cast("long"))
    side = lambda n: r.where(F.col("nr") == n).select("k", "start", "stop", "complete", "total")
    return intervals.union(side(1), side(2), ["k"]).select("k", "start", "stop", "complete")

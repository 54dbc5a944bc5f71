"""Operator 6: lines that a site repeats on more than a share of its pages are dropped. DataFrame functions only.

For each host, the pages that hold a line are counted once each and divided by the host's pages. A line above
``max_ratio``, on ``min_pages`` pages at least, is boilerplate there and goes from all of the host's pages. The longer a
line, the less it is repeated by chance: a line of w words, six characters each, is boilerplate from ``max_ratio`` / w
on. Those below ``max_ratio`` itself stay on pages that would lose more than three quarters of their text by them: such a
page is a copy of others, and which copy stays isn't for this operator to say.

A host can have no more than (words a page) / max_ratio of such lines. They are counted. Where no host has more than
``most_listed`` they are looked up in a list a host; else lines are joined by host and line, with a broadcast of up to
``most_broadcast`` of them. Texts are not shuffled but in the join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

WORD_CHARS = 6


def host_of(url: Column | str) -> Column:
    """The host that a URL names, in lower case; null where it names none."""
    url = F.col(url) if isinstance(url, str) else url
    return F.lower(F.nullif(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))


def trimmed(line: Column) -> Column:
    return F.regexp_replace(line, r"[ \t\r\x0B\f]+\z", "")


def line_key(line: Column) -> Column:
    """A line without white space at its end; lines of white space alone have none."""
    return F.when(trimmed(line).rlike(r"[^ \t\r\x0B\f]"), F.xxhash64(trimmed(line)))


def boilerplate(pages: DataFrame, max_ratio: float, min_pages: int) -> DataFrame:
    """host, line, often (over ``max_ratio`` whatever its length): ``pages`` has host and keys (structs of line, a line
    key, and chars, in order)."""
    once = pages.select("host", F.explode(F.array_distinct("keys")).alias("x")).where("x.line IS NOT NULL").select("host", "x.line", "x.chars")
    counted = once.groupBy("host", "line").agg(F.count("*").alias("n"), F.max("chars").alias("chars")).where(F.col("n") >= min_pages)
    totals = pages.groupBy("host").agg(F.count("*").alias("pages"))
    both = counted.join(totals, counted["host"].eqNullSafe(totals["host"]))
    limit, words = F.lit(max_ratio) * F.col("pages"), F.greatest(F.lit(1.0), F.col("chars") / WORD_CHARS)
    return both.where(F.col("n") * words > limit).select(counted["host"], "line", (F.col("n") > limit).alias("often"))


def line_dedup(docs: DataFrame, host: Column | str | None = None, text_col: str = "text", max_ratio: float = 0.1, min_pages: int = 5, most_broadcast: int = 500_000, most_listed: int = 256) -> DataFrame:
    """Columns ``row`` (the document's, as a struct), ``text`` (what is left), ``n_lines``, ``n_dropped``.

    ``host`` is a column, or its name; by default the host of ``url`` where there is such a column, else ``source``.

    A null text stays null, with no lines. A null host is a host of its own. Each row is a page, repeated ones too; a
    line that a page repeats counts once and goes everywhere. Blank lines stay. Hosts with fewer pages than
    ``min_pages`` lose nothing. An empty table gives no rows. The struct keeps columns of any name apart from the new ones.
    """
    if host is None:
        host = host_of("url") if "url" in docs.columns else "source"
    host = F.col(host) if isinstance(host, str) else host
    keys = F.transform(F.split(F.col(text_col), "\n", -1), lambda x: F.struct(line_key(x).alias("line"), F.length(trimmed(x)).alias("chars")))
    found = materialise(boilerplate(docs.select(host.alias("host"), keys.alias("keys")), max_ratio, min_pages), "boilerplate")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), host.alias("host"), F.split(F.col(text_col), "\n", -1).alias("lines"))
    n_found = found.count()
    largest = found.groupBy("host").count().agg(F.max("count")).first()[0] or 0
    if n_found <= most_broadcast and largest <= most_listed:
        drop = lambda often: F.coalesce(F.collect_list(F.when(F.col("often") == often, F.col("line"))), F.array().cast("array<bigint>"))
        lists = found.groupBy(F.col("host").alias("of")).agg(drop(True).alias("first"), drop(False).alias("second")).select("of", F.concat("first", "second").alias("drop"), F.size("first").alias("n_often"))
        kind = lambda x: F.coalesce(F.array_position("drop", line_key(x)), F.lit(0))
        places = F.when(F.col("drop").isNotNull(), F.transform("lines", kind))
        marked = rows.join(F.broadcast(lists), F.col("host").eqNullSafe(F.col("of")), "left").withColumn("places", places)
    else:
        numbered = materialise(rows.withColumn("nth", F.monotonically_increasing_id()), "numbered")
        each = numbered.select("nth", "host", F.posexplode("lines").alias("at", "line")).withColumn("key", line_key(F.col("line")))
        lines = found.select(F.col("host").alias("of"), F.col("line").alias("drop"), F.when(F.col("often"), 1).otherwise(2).cast("long").alias("place"))
        gone = each.join(F.broadcast(lines) if n_found <= most_broadcast else lines, F.col("host").eqNullSafe(F.col("of")) & (F.col("key") == F.col("drop")), "left")
        again = gone.groupBy("nth").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", F.coalesce("place", F.lit(0)).alias("place")))), lambda x: x["place"]).alias("places"))
        marked = numbered.join(again, "nth", "left").withColumn("n_often", F.lit(1))
    of = lambda test: F.filter("lines", lambda x, i: test(F.get("places", i)))
    chars = lambda c: F.length(F.array_join(c, ""))
    clean, rare = of(lambda p: p == 0), of(lambda p: p > F.col("n_often"))
    marked = marked.withColumn("clean", F.when(F.col("places").isNotNull(), clean).otherwise(F.col("lines")))
    copy = F.col("places").isNotNull() & (chars(rare) > 3 * chars(F.col("clean")))
    kept = marked.withColumn("left", F.when(copy, of(lambda p: (p == 0) | (p > F.col("n_often")))).otherwise(F.col("clean")))
    n_lines = F.coalesce(F.size("lines"), F.lit(0))
    n_lines = F.when(F.col("lines").isNull(), F.lit(0)).otherwise(n_lines)
    n_left = F.when(F.col("left").isNull(), F.lit(0)).otherwise(F.size("left"))
    return kept.select("row", F.when(F.col("lines").isNotNull(), F.array_join("left", "\n")).alias("text"), n_lines.cast("long").alias("n_lines"), (n_lines - n_left).cast("long").alias("n_dropped"))

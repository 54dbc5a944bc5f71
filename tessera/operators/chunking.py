"""Chunks of source files: one for each symbol, or one for a small or symbol-less file.

Everything but finding the symbols is column expressions over a file's own lines: nothing is shuffled.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lines import lines_of
from ..functions.text import breadcrumb, chunk_id, content_hash, embedded_text, extension, forward_slashes, is_indexable, is_test_path, trim_space, weighted_fields
from .symbols import extracted

# Fixed values.
SMALL_LINES, FILE_BYTES = 40, 2 * 1024 * 1024


# Characters of white space.
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def ends_of_indents(lines: list[str]) -> list[int]:
    """Last line (from 1) of a block that begins at each line: up to the next line that isn't indented more.

    Blank lines and comments neither end a block nor make it longer at the end of the file. One pass, from the last line on.
    """
    n = len(lines)
    ends, last_solid = [n] * n, 0
    depths, at = [], []  # of solid lines below, each less indented than those between, the nearest last
    for j in range(n, 0, -1):
        body = lines[j - 1].lstrip(SPACE)
        depth = len(lines[j - 1]) - len(body)
        if k := bisect_right(depths, depth):
            ends[j - 1] = at[k - 1] - 1
        elif last_solid:
            ends[j - 1] = last_solid
        if body and body[0] != "#":
            last_solid = last_solid or j
            while depths and depths[-1] >= depth:
                depths.pop()
                at.pop()
            depths.append(depth)
            at.append(j)
    return ends


def ends_of_braces(lines: list[str]) -> list[int]:
    """Line on which the braces that open from each line (from 1) on are closed again; the last line where they never are.

    One pass, from the last line on.
    """
    depth = [0]
    for x in lines:
        depth.append(depth[-1] + x.count("{") - x.count("}"))
    ends, low, at = [len(lines)] * len(lines), [], []  # low, at: depths that no line between is as low as, the nearest line last
    for j in range(len(lines), 0, -1):
        while low and low[-1] >= depth[j]:
            low.pop()
            at.pop()
        low.append(depth[j])
        at.append(j)
        i = j if "{" in lines[j - 1] else 0
        while i and (i == j or "{" not in lines[i - 1]):
            if k := bisect_right(low, depth[i - 1]):
                ends[i - 1] = at[k - 1]
            i -= 1
    return ends


def _ends(it: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for texts, indented in it:
        yield pd.Series([None if t is None else (ends_of_indents if by else ends_of_braces)(t.split("\n")) for t, by in zip(texts, indented, strict=True)], dtype=object)


def block_ends(text: Column | str, by_indent: Column) -> Column:
    """Where a block that begins on each of a text's lines ends, by indentation or by braces; null for a null text.

    A line's end depends on all that follow, so a text is one pass of Python, in Arrow batches, not a fold for each line.
    """
    return F.pandas_udf(_ends, "array<int>")(text, by_indent)


def chunked(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """id, path, start, stop, symbol, kind, signature, breadcrumb, content, embedded, indexed, hash.

    Ends come from the parser if it told them, else from indentation (Python) or braces, cut before the next symbol but for
    classes and tests. A symbol within the class before it is shown as its. Oversized or unknown files give nothing.
    """
    f = files.where(is_indexable(path) & (F.octet_length(content) <= FILE_BYTES)).select(forward_slashes(path).alias("path"), F.col(content).alias("content"))
    f = f.withColumns({"lines": lines_of("content"), "defs": extracted("path", "content", is_test_path("path"))})
    small = (F.size("lines") <= SMALL_LINES) | (F.size("defs") == 0)
    crumb = F.concat(F.lit("// [File: "), F.col("path"), F.lit("]"))
    stop = F.size("lines")
    whole = f.where(small).select(
        chunk_id(F.col("path"), F.lit(1), stop).alias("id"), "path", F.lit(1).alias("start"), stop.alias("stop"), F.regexp_extract("path", r"([^/]*)$", 1).alias("symbol"), F.lit("file").alias("kind"),
        F.concat(F.lit("File: "), F.col("path")).alias("signature"), crumb.alias("breadcrumb"), "content", embedded_text(crumb, F.col("content")).alias("embedded"),
    )
    n = F.size("lines")
    d = f.where(~small).withColumn("ends", block_ends("content", F.lower(extension("path")) == ".py"))

    def span(x: Column, i: Column) -> Column:
        own = F.when(x["end_line"] >= x["line"], F.least(n, x["end_line"])).otherwise(F.element_at("ends", x["line"]))
        following = F.try_element_at("defs", i + 2)["line"]
        cut = F.when(following.isNotNull() & (own >= following) & ~x["kind"].isin("class", "test"), F.least(own, following - 1)).otherwise(own)
        return F.struct(x["name"].alias("name"), x["kind"].alias("kind"), x["signature"].alias("signature"), x["line"].alias("start"), F.greatest(x["line"], F.least(n, cut)).alias("stop"))

    d = d.withColumn("spans", F.transform("defs", span))
    classes = F.filter("spans", lambda c: c["kind"] == "class")

    def parent(x: Column) -> Column:
        before = F.filter(classes, lambda c: c["start"] <= x["start"])
        last = F.try_element_at(before, F.lit(-1))
        return F.when((x["kind"] != "class") & (x["start"] <= last["stop"]), last["name"])

    d = d.select("path", "lines", F.explode(F.transform("spans", lambda x: F.struct(x.alias("s"), parent(x).alias("parent")))).alias("x")).select("path", "lines", "x.s.*", "x.parent")
    text = F.array_join(F.slice("lines", F.col("start"), F.col("stop") - F.col("start") + 1), "\n")
    crumb = breadcrumb(F.col("path"), F.col("parent"), F.col("kind"), F.col("name"))
    each = d.withColumn("content", text).where(trim_space("content") != "").select(
        chunk_id(F.col("path"), F.col("start"), F.col("stop"), F.col("name")).alias("id"), "path", "start", "stop", F.col("name").alias("symbol"), "kind", "signature", crumb.alias("breadcrumb"), "content", embedded_text(crumb, F.col("content"), F.col("signature")).alias("embedded"),
    )
    both = whole.unionByName(each)
    return both.withColumn("indexed", weighted_fields(F.col("symbol"), F.col("signature"), F.col("breadcrumb"), F.col("content"))).withColumn("hash", content_hash("content"))


def clamped_to_next(defs: DataFrame, keys: list[str]) -> DataFrame:
    """``defs`` (line, stop, kind) with stop cut before the next symbol, but for classes and tests."""
    following = F.lead("line").over(Window.partitionBy(*keys).orderBy("line"))
    cut = F.when(following.isNotNull() & ~F.col("kind").isin("class", "test"), F.least("stop", following - 1)).otherwise(F.col("stop"))
    return defs.withColumn("stop", F.greatest("line", cut))


def enclosing_class(defs: DataFrame, keys: list[str]) -> DataFrame:
    """``defs`` (line, stop, kind, name) with parent: the last class that begins before and ends after."""
    w = Window.partitionBy(*keys).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("kind") == "class", F.struct("name", "stop")), ignorenulls=True).over(w)
    return defs.withColumn("last", last).withColumn("parent", F.when((F.col("kind") != "class") & (F.col("line") <= F.col("last.stop")), F.col("last.name"))).drop("last")

"""Finding and replacing blocks of text: exact, white-space tolerant, fuzzy; each stage on what the one before left.

Requests have id, content, search, replace and line_hint (null for none). Contents are compared with LF line ends and
written back with those they had.
"""

from __future__ import annotations

import difflib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lines import line_span
from ..functions.text import trim_space, with_line_ends
from ..functions.vectors import let

# Fixed values.
FUZZY_SCORE, FUZZY_MARGIN = 0.85, 0.05


def _lf(x: Column) -> Column:
    return F.replace(x, F.lit("\r\n"), F.lit("\n"))


def occurrences(content: Column, search: Column) -> Column:
    """Offsets (from 0) of all occurrences, overlapping ones too.

    A fold that jumps from one occurrence to the next; a content without the block is not folded at all.
    """
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))

    def step(a: Column, _: Column) -> Column:
        at = F.when(a["at"] >= 0, F.call_function("locate", search, content, a["at"] + 1)).otherwise(0)
        return F.struct(F.when(at > 0, at).otherwise(-1).alias("at"), F.when(at > 0, F.concat(a["out"], F.array(at - 1))).otherwise(a["out"]).alias("out"))

    # what is left when the block is taken out tells how many lie apart; for each of these, so many can overlap
    apart = F.floor((F.length(content) - F.length(F.replace(content, search, F.lit("")))) / F.length(search))
    self_overlap = F.instr(F.substr(search, F.lit(2)), F.left(search, F.lit(1))) > 0
    most = F.when(self_overlap, apart * F.length(search)).otherwise(apart)
    tries = F.sequence(F.lit(1), F.greatest(F.lit(1), most.cast("int")))
    return F.when((F.length(search) > 0) & F.contains(content, search), F.aggregate(tries, start, step, lambda a: a["out"])).otherwise(F.array().cast("array<int>"))


def _nearest(places: Column, hint: Column, line_of) -> Column:
    """The place whose line is nearest to the hint, the first of several; the only one without a hint."""
    rated = F.transform(places, lambda p: F.struct(F.abs(line_of(p) - hint).alias("far"), p.alias("p")))
    return F.when(F.size(places) == 1, F.element_at(places, 1)).when((F.size(places) > 1) & hint.isNotNull(), F.array_min(rated)["p"])


def normalised_places(lines: Column, wanted: Column) -> Column:
    """Lines (from 0) at which the trimmed lines of the block follow one another, blank ones included.

    Places of the block's first line come first, so the slices that are compared are few.
    """

    def places(ls: Column, ws: Column) -> Column:
        n = F.size(ws)
        at = F.filter(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(ls) - n)), lambda i: F.try_element_at(ls, i + 1) == F.element_at(ws, 1))
        return F.when(F.size(ls) >= n, F.filter(at, lambda i: F.slice(ls, i + 1, n) == ws)).otherwise(F.array().cast("array<int>"))

    return let(lines, lambda ls: let(wanted, lambda ws: places(ls, ws)))


def locate_exact(requests: DataFrame) -> DataFrame:
    """``requests`` with n_exact, at (offset of the match that is taken, null if none or ambiguous), span."""
    d = requests.withColumns({"c": _lf(F.col("content")), "s": _lf(F.col("search"))})
    blank = F.length(trim_space("s")) == 0
    d = d.withColumn("places", F.when(blank, F.array().cast("array<int>")).otherwise(occurrences(F.col("c"), F.col("s"))))
    line_of = lambda p: F.size(F.split(F.substr(F.col("c"), F.lit(1), p), "\n", -1))
    d = d.withColumn("n_exact", F.size("places")).withColumn("at", _nearest(F.col("places"), F.col("line_hint"), line_of))
    return d.withColumn("span", F.when(F.col("at").isNotNull(), line_span(F.col("c"), F.col("at"), F.length("s")))).withColumn("blank", blank).drop("places")


def _trimmed(content: Column) -> Column:
    return F.transform(F.split(content, "\n", -1), lambda x: trim_space(x))


def locate_normalised(exact: DataFrame) -> DataFrame:
    """The same by trimmed lines, for rows of ``locate_exact`` without an exact match: n_normal, line (from 0)."""
    open_ = ~F.col("blank") & (F.col("n_exact") == 0)
    d = exact.withColumn("places", F.when(open_, normalised_places(_trimmed(F.col("c")), _trimmed(F.col("s")))))
    return d.withColumn("n_normal", F.size("places")).withColumn("line", F.when(open_, _nearest(F.col("places"), F.col("line_hint"), lambda p: p + 1))).drop("places")


def blocks_in(files: DataFrame, blocks: DataFrame) -> DataFrame:
    """id, block, line (from 0): every place of a file (id, content) where a block (block, search) stands, by trimmed lines.

    A block's longest line (the first of several) is its anchor, as a long line is held by few files: files' lines are joined
    with anchors by equality, and the lines round a hit are compared with the whole block. Blank blocks, and null texts, are
    found nowhere; overlapping places all count.
    """
    b = blocks.where(F.length(trim_space("search")) > 0).select("block", _trimmed(_lf(F.col("search"))).alias("w"))
    longest = F.array_max(F.transform("w", lambda x, i: F.struct(F.length(x).alias("n"), (-i).alias("o"))))
    b = b.withColumn("o", -longest["o"]).withColumn("anchor", F.element_at("w", F.col("o") + 1))
    keyed = b.select("block", "o", F.size("w").alias("k"), F.sha2(F.array_join("w", "\n").cast("binary"), 256).alias("whole"), F.xxhash64("anchor").alias("anchor"))
    f = files.where("content IS NOT NULL").select("id", _trimmed(_lf(F.col("content"))).alias("ls"))
    lines = f.select("id", "ls", F.posexplode("ls").alias("at", "x")).where(F.length("x") > 0).select("id", "at", F.xxhash64("x").alias("anchor"))
    met = lines.join(keyed, "anchor").select("id", "block", "k", "whole", (F.col("at") - F.col("o")).alias("line")).where("line >= 0")
    asked = met.groupBy("id").agg(F.collect_set(F.struct("block", "k", "whole", "line")).alias("asked"))
    told = f.join(asked, "id").select("id", "ls", F.explode("asked").alias("a"))
    same = F.sha2(F.array_join(F.slice("ls", F.col("a.line") + 1, F.col("a.k")), "\n").cast("binary"), 256) == F.col("a.whole")
    return told.where((F.col("a.line") + F.col("a.k") <= F.size("ls")) & same).select("id", "a.block", "a.line")


def _same_start(a: str, b: str) -> int:
    """Characters that both begin with, by halving."""
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def common_share(a: str, b: str) -> float:
    """Characters of a longest common subsequence over the longer length."""
    if a == b:
        return 1.0
    longest = max(len(a), len(b))
    # what both begin and end with belongs to a longest one, so only the middle is compared
    start = _same_start(a, b)
    a, b = a[start:], b[start:]
    end = _same_start(a[::-1], b[::-1])
    a, b = a[: len(a) - end], b[: len(b) - end]
    if len(a) < len(b):
        a, b = b, a
    # bit-parallel: one bit for each character of the longer string
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | 1 << i
    row = full = (1 << len(a)) - 1
    for ch in b:
        hit = row & masks.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return (start + end + len(a) - row.bit_count()) / longest


def best_window(content: str, search: str, floor: float = FUZZY_SCORE - FUZZY_MARGIN) -> tuple[int, float, float]:
    """Line (from 0) and score of the best window, and the score of the next best; -1 where none reaches ``floor``.

    A common subsequence is no longer than the shorter line, nor than the characters that both have; windows that can't
    reach the floor by these bounds aren't compared.
    """
    lines, wanted = [x.strip() for x in content.split("\n")], [x.strip() for x in search.split("\n")]
    k, known = len(wanted), {}
    bags: dict[str, Counter] = {}

    def bag(x: str) -> Counter:
        if x not in bags:
            bags[x] = Counter(x)
        return bags[x]

    def by_length(a: str, b: str) -> float:
        return min(len(a), len(b)) / (max(len(a), len(b)) or 1) if a != b else 1.0

    def by_characters(a: str, b: str) -> float:
        return (bag(a) & bag(b)).total() / (max(len(a), len(b)) or 1) if a != b else 1.0

    def share(a: str, b: str) -> float:
        if (a, b) not in known:
            known[a, b] = common_share(a, b)
        return known[a, b]

    best: list[tuple[float, int]] = []
    for i in range(len(lines) - k + 1):
        pairs = list(zip(lines[i : i + k], wanted, strict=True))
        if all(sum(f(a, b) for a, b in pairs) >= floor * k for f in (by_length, by_characters)):
            score = sum(share(a, b) for a, b in pairs) / k
            if score >= floor:
                best = sorted([*best, (-score, i)])[:2]
    if not best:
        return -1, -1.0, -1.0
    return best[0][1], -best[0][0], -best[1][0] if len(best) > 1 else -1.0


def _fuzzy(it: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for contents, searches in it:
        yield pd.DataFrame([(-1, -1.0, -1.0) if c is None else best_window(c, s) for c, s in zip(contents, searches, strict=True)], columns=["line", "best", "second"])


def fuzzy(content: Column | str, search: Column | str) -> Column:
    """line, best, second of the best window; a null content has none."""
    return F.pandas_udf(_fuzzy, "line int, best double, second double")(content, search)


def located(requests: DataFrame) -> DataFrame:
    """``requests`` with c (LF content), s, strategy (exact, whitespace_normalized, fuzzy or none), error, at, line, first,
    last and score. More than one match without a hint is refused.

    Each stage does its work only on rows that earlier ones left, in one pass over the requests.
    """
    d = locate_normalised(locate_exact(requests))
    left = ~F.col("blank") & (F.col("n_exact") == 0) & (F.col("n_normal") == 0)
    d = d.withColumn("f", fuzzy(F.when(left, F.col("c")), F.when(left, F.col("s"))))
    good = left & (F.col("f.best") >= FUZZY_SCORE)
    close = good & (F.col("f.second") >= 0) & (F.col("f.best") - F.col("f.second") < FUZZY_MARGIN - 1e-9)
    is_exact, is_normal, is_fuzzy = F.col("at").isNotNull(), F.col("line").isNotNull(), good & ~close
    many = lambda n, what: F.concat(F.lit("ambiguous: "), n.cast("string"), F.lit(f" {what} matches"))
    error = (
        F.when(F.col("blank"), "empty").when(F.col("n_exact") > 0, F.when(~is_exact, many(F.col("n_exact"), "exact"))).when(F.col("n_normal") > 0, F.when(~is_normal, many(F.col("n_normal"), "normalized")))
        .when(close, "ambiguous: fuzzy candidates are too close").when(~good, "not found")
    )
    line = F.when(is_normal, F.col("line")).when(is_fuzzy, F.col("f.line"))
    rows = F.size(F.split("s", "\n", -1))
    strategy = F.when(is_exact, "exact").when(is_normal, "whitespace_normalized").when(is_fuzzy, "fuzzy").otherwise("none")
    return d.select(
        *requests.columns, "c", "s", strategy.alias("strategy"), error.alias("error"), F.col("at").cast("int").alias("at"), line.cast("int").alias("line"),
        F.when(is_exact, F.col("span.first")).otherwise(line + 1).cast("long").alias("first"), F.when(is_exact, F.col("span.last")).otherwise(line + rows).cast("long").alias("last"),
        F.when(is_exact | is_normal, F.lit(1.0)).when(left & (F.col("f.best") >= 0), F.col("f.best")).alias("score"),
    )


def applied(found: DataFrame) -> DataFrame:
    """``found`` (of ``located``, with ``replace``) with new_content: the block put in; unchanged where nothing was found."""
    crlf = F.contains("content", F.lit("\r\n"))
    r = _lf(F.col("replace"))
    spliced = F.concat(F.substr("c", F.lit(1), F.col("at")), r, F.substr("c", F.col("at") + F.length("s") + 1))
    lines = F.split("c", "\n", -1)
    n = F.size(F.split("s", "\n", -1))
    rest = F.size(lines) - F.col("line") - n
    window = F.array_join(F.concat(F.slice(lines, 1, F.col("line")), F.array(r), F.slice(lines, F.col("line") + n + 1, F.greatest(rest, F.lit(0)))), "\n")
    new = F.when(F.col("at").isNotNull(), spliced).when(F.col("line").isNotNull(), window)
    return found.withColumn("new_content", F.when(new.isNull(), F.col("content")).otherwise(with_line_ends(new, crlf)))


def to_write(changed: DataFrame, current: DataFrame, key: str = "path") -> DataFrame:
    """key, new_content, was: edits whose file is still what was read. ``changed``: key, content (as read), new_content.
    ``current``: key, content (as it is now). Others have changed meanwhile and are left alone, as are edits that change nothing."""
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    now = current.select(key, digest("content").alias("now"))
    d = changed.withColumn("was", digest("content")).join(now, key).where("was = now")
    return d.where(F.col("new_content") != F.col("content")).select(key, "new_content", "was")


def unified_diff(before: str, after: str, path: str = "file", context: int = 3) -> str:
    return "\n".join(difflib.unified_diff(before.split("\n"), after.split("\n"), f"a/{path}", f"b/{path}", n=context, lineterm=""))


def _diffs(it: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b, p in it:
        yield pd.Series([unified_diff(x, y, z) for x, y, z in zip(a, b, p, strict=True)])


def diff_text(before: Column | str, after: Column | str, path: Column | str) -> Column:
    return F.pandas_udf(_diffs, "string")(before, after, path)


def apply_blocks(found: DataFrame, key: str = "path") -> DataFrame:
    """Several blocks of one file at once: key, ok, error, new_content. ``found``: of ``located``, with key, content, replace.

    All blocks are found in the content as it was. If one isn't, or two overlap, the file is left alone. Blocks are put
    in from the last to the first, so places stay true.
    """
    end = F.when(F.col("at").isNotNull(), F.col("at") + F.length("s"))
    lines = F.split("c", "\n", -1)
    before = F.length(F.array_join(F.slice(lines, 1, F.col("line")), "\n")) + F.when(F.col("line") > 0, 1).otherwise(0)
    body = F.length(F.array_join(F.slice(lines, F.col("line") + 1, F.size(F.split("s", "\n", -1))), "\n"))
    span = F.struct(F.coalesce("at", before).cast("int").alias("a"), F.coalesce(end, before + body).cast("int").alias("z"), _lf(F.col("replace")).alias("r"))
    g = found.groupBy(key).agg(F.first("content").alias("content"), F.first("c").alias("c"), F.min("error").alias("error"), F.sort_array(F.collect_list(F.when(F.col("strategy") != "none", span)), False).alias("spans"))
    pairs = F.zip_with(F.slice("spans", 2, F.greatest(F.size("spans") - 1, F.lit(0))), F.slice("spans", 1, F.greatest(F.size("spans") - 1, F.lit(0))), lambda lo, hi: lo["z"] > hi["a"])
    overlap = F.exists(pairs, lambda x: x)
    put = lambda text, s: F.concat(F.substr(text, F.lit(1), s["a"]), s["r"], F.substr(text, s["z"] + 1))
    new = with_line_ends(F.aggregate("spans", F.col("c"), put), F.contains("content", F.lit("\r\n")))
    error = F.coalesce("error", F.when(overlap, F.lit("blocks overlap")))
    return g.select(key, error.isNull().alias("ok"), error.alias("error"), F.when(error.isNull(), new).otherwise(F.col("content")).alias("new_content"))


def edit_files(found: DataFrame, batch: str = "batch", key: str = "path") -> DataFrame:
    """All files of a batch or none: batch, key, ok, new_content. A path named twice in a batch is refused by ``duplicates``."""
    each = found.groupBy(batch, key).agg(F.min("error").alias("e"))
    bad = each.where("e IS NOT NULL").select(batch).distinct().withColumn("bad", F.lit(True))
    one = apply_blocks(found.withColumn("_k", F.struct(batch, key)), "_k").select(F.col(f"_k.{batch}").alias(batch), F.col(f"_k.{key}").alias(key), "ok", "new_content")
    fails = one.where("NOT ok").select(batch).distinct().withColumn("fails", F.lit(True))
    originals = found.groupBy(batch, key).agg(F.first("content").alias("content"))
    d = one.join(bad, batch, "left").join(fails, batch, "left").join(originals, [batch, key])
    ok = F.col("bad").isNull() & F.col("fails").isNull()
    return d.select(batch, key, ok.alias("ok"), F.when(ok, F.col("new_content")).otherwise(F.col("content")).alias("new_content"))


def duplicates(requests: DataFrame, keys: list[str]) -> DataFrame:
    return requests.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def shifted_lines(blocks: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """``blocks`` (first, last, n_new) with now_first: where each begins after those before it changed the line count."""
    w = Window.partitionBy(*keys).orderBy("first", order).rowsBetween(Window.unboundedPreceding, -1)
    moved = F.coalesce(F.sum(F.col("n_new") - (F.col("last") - F.col("first") + 1)).over(w), F.lit(0))
    return blocks.withColumn("now_first", F.col("first") + moved)

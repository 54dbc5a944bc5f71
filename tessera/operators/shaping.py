"""Search results as text: full, preview or summary entries under a budget of characters.

``hits`` has rank (from 1), id, path, kind, symbol, signature, breadcrumb, start_line, end_line, content, signal, matches,
and ``of`` where results of several queries are shaped at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lines import lines_of
from ..functions.text import clip_to_budget, compact_signature, forward_slashes, language_of, query_tokens

# Fixed values.
BUDGET, PREVIEW_LINES, PREVIEW_CHARS, FULL_CHARS, PREVIEW_HITS, BEFORE = 8000, 12, 1400, 6000, 3, 2


def header() -> Column:
    """Place, kind, symbol, signature, signal and first matches of a hit."""
    sig = compact_signature("signature")
    head = F.when((F.length(sig) > 0) & (sig != F.col("symbol")), F.concat(F.lit(" — "), sig)).otherwise(F.lit(""))
    signal = F.when(F.length("signal") > 0, F.concat(F.lit(" ["), F.col("signal"), F.lit("]"))).otherwise(F.lit(""))
    matches = F.when(F.size("matches") > 0, F.concat(F.lit("; matches: "), F.array_join(F.slice("matches", 1, 5), ", "))).otherwise(F.lit(""))
    return F.concat(_place(), F.col("symbol"), head, signal, matches)


def _place() -> Column:
    return F.concat(forward_slashes("path"), F.lit(":"), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string"), F.lit(" ["), F.col("kind"), F.lit("] "))


def _fenced(body: Column) -> Column:
    return F.concat(F.lit("\n```"), language_of("path"), F.lit("\n"), body, F.lit("\n```"))


def full_entry() -> Column:
    return F.concat(_place(), F.col("symbol"), F.lit(" ("), F.col("breadcrumb"), F.lit("):"), _fenced(F.col("content")))


def best_line(content: Column, query: str) -> Column:
    """The first line, from 0, that holds most of the query's distinct tokens; 0 if none does."""
    terms = list(dict.fromkeys(query_tokens(query)))
    lines = lines_of(content)
    if not terms:
        return F.lit(0)

    def score(line: Column) -> Column:
        low, out = F.lower(line), F.lit(0)
        for t in terms:
            out = out + F.contains(low, F.lit(t)).cast("int")
        return out

    scores = F.transform(lines, score)
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def previews(hits: DataFrame, query: str) -> DataFrame:
    """``hits`` with best (from 0), first and last (from 0, last exclusive), clipped, body, preview."""
    lines = lines_of("content")
    n = F.size(lines)
    d = hits.withColumn("best", best_line(F.col("content"), query))
    start = F.greatest(F.lit(0), F.col("best") - BEFORE)
    d = d.withColumn("first", F.when(start + PREVIEW_LINES > n, F.greatest(F.lit(0), n - PREVIEW_LINES)).otherwise(start))
    d = d.withColumn("last", F.least(n, F.col("first") + PREVIEW_LINES))
    number = lambda c: c.cast("string")
    above = F.when(F.col("first") > 0, F.concat(F.lit("... lines "), number(F.col("start_line")), F.lit("-"), number(F.col("start_line") + F.col("first") - 1), F.lit(" omitted ...\n"))).otherwise(F.lit(""))
    below = F.when(F.col("last") < n, F.concat(F.lit("\n... lines "), number(F.col("start_line") + F.col("last")), F.lit("-"), number(F.col("end_line")), F.lit(" omitted ..."))).otherwise(F.lit(""))
    d = d.withColumn("excerpt", F.concat(above, F.array_join(F.slice(lines, F.col("first") + 1, F.col("last") - F.col("first")), "\n"), below))
    d = d.withColumn("clipped", F.length("excerpt") > PREVIEW_CHARS)
    d = d.withColumn("body", F.when(F.col("clipped"), F.concat(F.substring("excerpt", 1, PREVIEW_CHARS), F.lit("\n... preview clipped ..."))).otherwise(F.col("excerpt")))
    return d.withColumn("preview", F.concat(header(), _fenced(F.col("body")))).drop("excerpt")


def within_budget(entries: DataFrame, budget: int = BUDGET, by: str = "of") -> DataFrame:
    """One row for each ``by``: text, truncated, ranges. ``entries``: by, rank, text, range (null where it shows none).

    Entries are taken until the first that doesn't fit, two characters between them; a first one that doesn't fit alone
    is clipped and shows no range; a note tells how many are left out. A group is one answer: a few entries.
    """
    w = Window.partitionBy(by).orderBy("rank")
    size = F.length("text") + F.when(F.row_number().over(w) > 1, F.lit(2)).otherwise(F.lit(0))
    d = entries.withColumn("nth", F.row_number().over(w)).withColumn("used", F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    d = d.withColumn("fits", F.min((F.col("used") <= budget).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)) == 1)
    g = d.groupBy(by).agg(
        F.count("*").alias("total"), F.count_if("fits").alias("kept"), F.coalesce(F.max(F.when(F.col("fits"), F.col("used"))), F.lit(0)).alias("used"), F.min_by("text", "nth").alias("first"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("fits"), F.struct("nth", "text")))), lambda x: x["text"]).alias("texts"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("fits") & F.col("range").isNotNull(), F.struct("nth", "range")))), lambda x: x["range"]).alias("ranges"),
    )
    lone = F.col("kept") == 0
    cut = clip_to_budget(F.col("first"), budget)
    body = F.when(lone, cut).otherwise(F.array_join("texts", "\n\n"))
    omitted = F.col("total") - F.when(lone, F.lit(1)).otherwise(F.col("kept"))
    used = F.when(lone, F.length(cut)).otherwise(F.col("used"))
    note = F.concat(F.lit("... "), omitted.cast("string"), F.lit(" additional match"), F.when(omitted == 1, F.lit("")).otherwise(F.lit("es")), F.lit(' omitted; use mode: "full" or a narrower query to inspect them ...'))
    room = F.greatest(F.lit(0), F.lit(budget) - used - 2)
    shown = clip_to_budget(note, room)
    text = F.when((omitted > 0) & (room > 0), F.concat(body, F.lit("\n\n"), shown)).otherwise(body)
    truncated = F.when(lone, F.length(cut) < F.length("first")).otherwise(omitted > 0) | ((omitted > 0) & (room > 0) & (F.length(shown) < F.length(note)))
    return g.select(by, text.alias("text"), truncated.alias("truncated"), F.col("ranges"))


def automatic_mode(n_hits: Column, first_content: Column) -> Column:
    return F.when((n_hits == 1) & (F.length(first_content) <= FULL_CHARS), "full").when(n_hits <= PREVIEW_HITS, "preview").otherwise("mixed")


def shaped(hits: DataFrame, query: str, mode: str = "auto", by: str = "of") -> DataFrame:
    """One row for each query: mode, text, truncated, ranges (id, first, last line shown whole)."""
    if mode not in ("auto", "full", "preview", "summary"):
        raise ValueError(f"unknown mode {mode!r}")
    if by not in hits.columns:
        hits = hits.withColumn(by, F.lit(0))
    counted = hits.groupBy(by).agg(F.count("*").alias("n_hits"), F.min_by("content", "rank").alias("lead"))
    modes = counted.select(by, "n_hits", automatic_mode(F.col("n_hits"), F.col("lead")).alias("mode") if mode == "auto" else F.lit(mode).alias("mode"))
    d = previews(hits, query).join(modes, by)
    whole = F.struct(F.col("id"), F.col("start_line").cast("long").alias("first"), F.col("end_line").cast("long").alias("last"))
    seen = F.struct(F.col("id"), (F.col("start_line") + F.col("first")).cast("long").alias("first"), (F.col("start_line") + F.col("last") - 1).cast("long").alias("last"))
    as_preview = (F.col("mode") == "preview") | ((F.col("mode") == "mixed") & (F.col("rank") <= PREVIEW_HITS))
    text = F.when(F.col("mode") == "full", full_entry()).when(as_preview, F.col("preview")).otherwise(header())
    shown = F.when(F.col("mode") == "full", whole).when(as_preview & ~F.col("clipped"), seen)
    entries = d.select(by, "rank", text.alias("text"), shown.alias("range"))
    bounded = within_budget(entries.join(modes.where("mode <> 'full'"), by, "left_semi"), BUDGET, by)
    every = entries.join(modes.where("mode = 'full'"), by, "left_semi").groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]), "\n\n").alias("text"), F.lit(False).alias("truncated"), F.transform(F.array_sort(F.collect_list(F.struct("rank", "range"))), lambda x: x["range"]).alias("ranges"))
    both = bounded.unionByName(every).join(modes, by)
    if mode == "full":
        return both.select(by, "mode", "text", "truncated", "ranges")
    lead = F.least(F.lit(PREVIEW_HITS), F.col("n_hits"))
    note = F.when(F.col("mode") == "mixed", F.concat(F.col("n_hits").cast("string"), F.lit(" matches returned; first "), lead.cast("string"), F.lit(" shown as previews, remaining "), (F.col("n_hits") - lead).cast("string"), F.lit(" summarized.\n\n"))).otherwise(F.lit(""))
    cut = clip_to_budget(F.col("text"), F.greatest(F.lit(0), F.lit(BUDGET) - F.length(note)))
    clipped = F.length(cut) < F.length("text")
    none = F.slice("ranges", 1, 0)
    return both.select(by, "mode", F.concat(note, cut).alias("text"), (F.col("truncated") | clipped).alias("truncated"), F.when(clipped, none).otherwise(F.col("ranges")).alias("ranges"))

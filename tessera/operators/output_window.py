"""Bounding of long outputs: which lines are shown, how wide, in how many bytes; and reading windows of files."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clamp_width, is_diagnostic, is_discovery_command, is_execution_command

# Fixed values.
MAX_LINES, MAX_WIDTH, MAX_BYTES = 100, 300, 20 * 1024
READ_LINES, READ_MOST_LINES, READ_BYTES = 250, 2000, 50 * 1024
BATCH_FILES, BATCH_LINES, BATCH_BYTES, FILE_BYTES = 20, 150, 24 * 1024, 5 * 1024 * 1024
LEAST_CENTRED, HEAD_SHARE, MOST_HEAD, TAIL_SHARE, MOST_TAIL, LEAST_ENDS = 8, 0.12, 4, 0.15, 5, 2
HOST_FOOTER = r"(?:\r?\n){1,2}\[(?:Showing (?:lines \d+-\d+ of \d+(?: \([^)]+\))?|last [^)]+\))\.[ \t]*Full output:|Truncated by host harness\.[ \t]*Full:)[ \t]*([^\]\r\n]+?)(?:[ \t]+\(use offset/limit with read if needed\))?\][ \t\r\n]*$"
OWN_FOOTER = r"(?:\r?\n){2}\[Truncated[^\r\n\]]*?(?:\.[ \t]*(?:Full|Spillover):[ \t]*([^\]\r\n]+?)(?:[ \t]+\(use offset/limit[^)]*\)|[ \t]+\(received fragment only\))?)?\][ \t\r\n]*$"


def output_lines(text: Column | str) -> Column:
    return F.split(F.col(text) if isinstance(text, str) else text, r"\r?\n", -1)


def prior_footer(text: Column | str) -> Column:
    """kind (host, own or null), path that the footer names, and the text before it."""
    t = F.col(text) if isinstance(text, str) else text
    kind = F.when(t.rlike(HOST_FOOTER), "host").when(t.rlike(OWN_FOOTER), "own")
    path = F.when(kind == "host", F.regexp_extract(t, HOST_FOOTER, 1)).when(kind == "own", F.regexp_extract(t, OWN_FOOTER, 1))
    rest = F.when(kind == "host", F.regexp_replace(t, HOST_FOOTER, "")).when(kind == "own", F.regexp_replace(t, OWN_FOOTER, "")).otherwise(t)
    return F.struct(kind.alias("kind"), F.nullif(F.trim(path), F.lit("")).alias("path"), rest.alias("text"))


def window_plan(outputs: DataFrame, max_lines: int = MAX_LINES) -> DataFrame:
    """``outputs`` (text, command, is_error) with total, first_diag (from 0), head, tail, win_start, win_end.

    Shown are the first ``head`` lines, those from win_start to win_end (exclusive, from 0), and the last ``tail``.
    A window round the first diagnostic line is chosen for failures; a plain head and tail otherwise.
    """
    m = max(2, max_lines)
    lines = output_lines("text")
    flagged, ok = F.coalesce("is_error", F.lit(False)), F.col("is_error").eqNullSafe(F.lit(False))
    looks = ~is_discovery_command("command") & ~ok
    scans = looks & (flagged | (F.col("is_error").isNull() & is_execution_command("command")))
    first = lambda on_error: F.array_position(F.transform(lines, lambda x: is_diagnostic(x, on_error)), True) - 1
    d = outputs.withColumn("total", F.size(lines))
    d = d.withColumn("over", F.col("total") > max_lines)
    diag = F.when(F.col("over") & scans, F.when(flagged, first(True)).otherwise(first(False)))
    d = d.withColumn("first_diag", F.when(diag >= 0, diag).cast("int"))
    centred = F.col("over") & looks & (flagged | F.col("first_diag").isNotNull()) & F.lit(m >= LEAST_CENTRED)
    head, tail = min(MOST_HEAD, max(LEAST_ENDS, int(HEAD_SHARE * m))), min(MOST_TAIL, max(LEAST_ENDS, int(TAIL_SHARE * m)))
    room = m - head - tail
    end = F.col("total") - tail
    start = F.greatest(F.lit(head), F.col("first_diag") - room // 2)
    stop = F.least(end, start + room)
    start = F.when(stop == end, F.greatest(F.lit(head), stop - room)).otherwise(start)
    no_hit = F.greatest(F.lit(head), end - room)
    return d.select(
        *outputs.columns, "total", "first_diag",
        F.when(centred, head).when(F.col("over"), m // 2).otherwise(F.col("total")).alias("head"),
        F.when(centred, tail).when(F.col("over"), m - m // 2).otherwise(0).alias("tail"),
        F.when(centred, F.when(F.col("first_diag").isNull(), no_hit).otherwise(start)).alias("win_start"),
        F.when(centred, F.when(F.col("first_diag").isNull(), end).otherwise(stop)).alias("win_end"),
    )


def shown_lines(outputs: DataFrame, keys: list[str], max_lines: int = MAX_LINES, max_width: int = MAX_WIDTH) -> DataFrame:
    """keys, n (from 1), line: the lines that are shown, each at most so wide."""
    d = window_plan(outputs, max_lines).select(*keys, "total", "head", "tail", "win_start", "win_end", F.posexplode(output_lines("text")).alias("i", "line"))
    shown = (F.col("i") < F.col("head")) | (F.col("i") >= F.col("total") - F.col("tail")) | F.coalesce((F.col("i") >= F.col("win_start")) & (F.col("i") < F.col("win_end")), F.lit(False))
    return d.where(shown).select(*keys, (F.col("i") + 1).alias("n"), clamp_width("line", F.col("i") + 1, max_width).alias("line"))


@dataclass(frozen=True)
class Entry:
    text: str
    is_marker: bool = False


def _marker(first: int, last: int) -> Entry:
    return Entry(f"\n[... {last - first + 1:,} lines omitted (lines {first}–{last}) ...]\n", True)


def compose(lines: list[str], plan: tuple, budget: int, full: str | None, prior: str | None) -> tuple[str, int]:
    """Text and number of shown lines, within ``budget`` bytes: markers go first, then entries from the middle.

    ``lines`` are those that the plan shows, in order, already cut to their width.
    """
    total, head, tail, win_start, win_end = plan
    gaps, entries, rest = [], [], iter(lines)

    def take(a: int, b: int) -> None:
        entries.extend(Entry(x) for _, x in zip(range(a, b), rest))

    def skip(a: int, b: int) -> None:
        if b > a:
            gaps.append((a + 1, b))
            entries.append(_marker(a + 1, b))

    take(0, head)
    if win_start is not None:
        skip(head, win_start)
        take(win_start, win_end)
        skip(win_end, total - tail)
    elif tail:
        skip(head, total - tail)
    take(total - tail, total)
    shown = sum(not e.is_marker for e in entries)
    widest = max(gaps, key=lambda g: (g[1] - g[0], -g[0]), default=None)

    def footer() -> str:
        if prior == "host":
            if full:
                return f"\n\n[Truncated: {shown} lines shown (host truncated). Full: {full} (use offset/limit with read if needed)]" if shown < total else f"\n\n[Truncated by host harness. Full: {full} (use offset/limit with read if needed)]"
            return "\n\n[Truncated by host harness]"
        if not full:
            return f"\n\n[Truncated: {shown}/{total} lines.]"
        out = f"\n\n[Truncated: {shown}/{total} lines. Full: {full} (use offset/limit with read if needed)]"
        if widest and budget >= 1024:
            n = min(250, widest[1] - widest[0] + 1)
            out += f'\nTo inspect omitted lines {widest[0]}–{widest[1]}: read({{ path: "{full}", offset: {widest[0]}, limit: {n} }})'
        return out

    size = lambda: len(("\n".join(e.text for e in entries) + footer()).encode())
    if size() > budget:
        at = next((i for i, e in enumerate(entries) if e.is_marker), None)
        if at is not None:
            del entries[at]
    now = size()
    while entries and now > budget:
        gone = entries.pop(len(entries) // 2)
        shown -= not gone.is_marker
        # what an entry took is known; only near the end is the text put together again
        now -= len(gone.text.encode()) + 1
        if now <= budget + 200:
            now = size()
    text = "\n".join(e.text for e in entries) + footer()
    return (text if len(text.encode()) <= budget else "[Truncated]"[:budget]), shown


def _planned(max_width: int) -> Column:
    """The lines that a plan shows, cut to their width: at most so many as the plan allows, whatever the output's length."""
    lines, win = output_lines("text"), F.coalesce(F.col("win_end") - F.col("win_start"), F.lit(0))
    parts = F.concat(F.slice(lines, 1, F.col("head")), F.slice(lines, F.coalesce("win_start", F.lit(0)) + 1, win), F.slice(lines, F.col("total") - F.col("tail") + 1, F.col("tail")))
    number = lambda i: F.when(i < F.col("head"), i).when(i < F.col("head") + win, F.col("win_start") + i - F.col("head")).otherwise(F.col("total") - F.col("tail") + i - F.col("head") - win) + 1
    return F.transform(parts, lambda x, i: clamp_width(x, number(i), max_width))


def clamp_outputs(outputs: DataFrame, max_lines: int = MAX_LINES, max_width: int = MAX_WIDTH, max_bytes: int = MAX_BYTES, spill_prefix: str | None = "spill") -> DataFrame:
    """One row an output (id, text, command, is_error): text, truncated, spill_path, original_bytes, returned_bytes, total, shown.

    Where lines are plenty or wide, or bytes too many, a window is composed; its footer names where the whole text is kept
    (``spilled`` gives those rows to write). The plan and its lines are column expressions, in one pass over the outputs;
    only those lines reach Python, where composing to a byte budget is a loop.
    """
    if max_bytes < 0:
        raise ValueError("max_bytes must not be negative")
    f = outputs.withColumn("f", prior_footer("text"))
    plan = window_plan(f.select("id", F.col("f.text").alias("text"), "command", "is_error", F.col("text").alias("raw"), F.col("f.kind").alias("kind"), F.col("f.path").alias("prior_path")), max_lines)
    wide = F.exists(output_lines("text"), lambda x: F.length(x) > max_width)
    needs = F.col("kind").isNotNull() | (F.col("total") > max_lines) | (F.octet_length("text") > max_bytes) | wide
    path = F.coalesce("prior_path", F.concat(F.lit(f"{spill_prefix}/"), F.substring(F.sha2(F.col("text").cast("binary"), 256), 1, 24), F.lit(".log")) if spill_prefix else F.lit(None).cast("string"))
    d = plan.withColumn("needs", F.coalesce(needs, F.lit(False))).withColumns({"spill_path": F.when(F.col("needs"), path), "planned": F.when(F.col("needs"), _planned(max_width))})

    @F.pandas_udf("text string, shown long")
    def composed(it: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for cols in it:
            out = []
            for lines, total, head, tail, a, b, full, kind in zip(*cols, strict=True):
                if lines is None:
                    out.append((None, None))
                    continue
                out.append(compose(list(lines), (int(total), int(head), int(tail), None if pd.isna(a) else int(a), None if pd.isna(b) else int(b)), max_bytes, full or None, kind or None))
            yield pd.DataFrame(out, columns=["text", "shown"])

    d = d.withColumn("c", composed("planned", "total", "head", "tail", "win_start", "win_end", "spill_path", "kind"))
    text = F.when(F.col("needs"), F.col("c.text")).otherwise(F.col("text"))
    total = F.col("total").cast("long")
    return d.select(
        "id", text.alias("text"), F.col("needs").alias("truncated"), "spill_path", F.octet_length("raw").cast("long").alias("original_bytes"), F.octet_length(text).cast("long").alias("returned_bytes"),
        total.alias("total"), F.when(F.col("needs"), F.col("c.shown")).otherwise(total).alias("shown"),
    )


def spilled(outputs: DataFrame, clamped: DataFrame) -> DataFrame:
    """spill_path, text: the whole texts of truncated outputs, for a sink."""
    return outputs.join(clamped.where("truncated AND spill_path IS NOT NULL").select("id", "spill_path"), "id").select("spill_path", "text")


# --- reading ---------------------------------------------------------------------------------------------------------
def readable(files: DataFrame, most: int = FILE_BYTES, size: str = "length") -> DataFrame:
    return files.where(F.col(size) <= most)


def line_window(files: DataFrame, keys: list[str], offset: int = 1, limit: int = READ_LINES, most_bytes: int = READ_BYTES, text: str = "content") -> DataFrame:
    """keys, n, line: lines from ``offset`` on, the longest run within the limits of lines and bytes (line ends between them count)."""
    limit, offset = min(max(1, limit), READ_MOST_LINES), max(1, offset)
    part = files.select(*keys, F.slice(F.split(text, "\n", -1), offset, limit).alias("ls"))
    def step(a: Column, x: Column) -> Column:
        fits = a["on"] & (a["used"] + F.octet_length(x) <= most_bytes)
        return F.struct((a["used"] + F.octet_length(x) + 1).alias("used"), F.when(fits, a["n"] + 1).otherwise(a["n"]).alias("n"), fits.alias("on"))

    ends = F.aggregate("ls", F.struct(F.lit(0).cast("long").alias("used"), F.lit(0).alias("n"), F.lit(True).alias("on")), step, lambda a: a["n"])
    return part.withColumn("ls", F.slice("ls", 1, ends)).select(*keys, F.posexplode("ls").alias("i", "line")).select(*keys, (F.col("i") + offset).cast("long").alias("n"), "line")


def batch_read(requests: DataFrame, keys: list[str], order: str = "seq", most_files: int = BATCH_FILES, lines: int = BATCH_LINES, most_bytes: int = BATCH_BYTES, text: str = "content") -> DataFrame:
    """Of each batch the first files, each cut to ``lines``, until the running total reaches ``most_bytes``; the one that
    crosses it is kept. Adds excerpt, nbytes, total."""
    w = Window.partitionBy(*keys).orderBy(order)
    d = requests.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= most_files)
    d = d.withColumn("excerpt", F.array_join(F.slice(F.split(text, "\n", -1), 1, lines), "\n")).withColumn("nbytes", F.octet_length("excerpt").cast("long"))
    d = d.withColumn("total", F.sum("nbytes").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.where(F.col("total") - F.col("nbytes") < most_bytes).drop("nth")


def as_image(files: DataFrame, content: str = "content") -> DataFrame:
    return files.withColumn("data", F.base64(content))


def uses_anchors(anchors: Column, raw: Column, read_mode: Column, method: Column, default: Column, targeted: Column) -> Column:
    """Whether lines are read with anchors: what was asked, then the mode, then the method, then the default for a part."""
    return (
        F.when(anchors.eqNullSafe(F.lit(True)), True)
        .when(raw.eqNullSafe(F.lit(True)) | anchors.eqNullSafe(F.lit(False)) | read_mode.eqNullSafe(F.lit("plain")), False)
        .when(read_mode.eqNullSafe(F.lit("anchored")) | method.eqNullSafe(F.lit("hash-anchor")), True)
        .when(F.coalesce(method.isin("line-range", "search-replace", "adaptive"), F.lit(False)), False)
        .otherwise(targeted & F.coalesce(default, F.lit(False)))
    )

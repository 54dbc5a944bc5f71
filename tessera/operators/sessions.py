"""Session logs: JSON lines to counts and totals, and the repair of usage records."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values.
MOST_FILE_BYTES, MOST_FOLDERS = 10 * 1024 * 1024, 20
NO_COST = {"input": 0, "output": 0, "cacheRead": 0, "cacheWrite": 0, "total": 0}
PROSE_LINE = r"(?:\.md|\.mdx|\.txt|\.rst):\d"
_USAGE = "STRUCT<input: DOUBLE, output: DOUBLE, totalTokens: DOUBLE, cost: STRUCT<input: DOUBLE, output: DOUBLE, cacheRead: DOUBLE, cacheWrite: DOUBLE, total: DOUBLE>>"
ENTRY = f"type STRING, id STRING, timestamp STRING, summary STRING, usage {_USAGE}, message STRUCT<role: STRING, toolName: STRING, content: ARRAY<STRUCT<type: STRING, text: STRING, name: STRING>>, usage: {_USAGE}>"


def entries(lines: DataFrame, text: str = "value") -> DataFrame:
    """``lines`` with ``e``, the parsed entry; null where a line is none."""
    return lines.withColumn("e", F.from_json(F.col(text), ENTRY))


def newest_folders(files: DataFrame, folder: str = "folder", mtime: str = "mtime", most: int = MOST_FOLDERS, most_bytes: int = MOST_FILE_BYTES) -> DataFrame:
    """Files of the newest folders, by a folder's latest file; files above ``most_bytes`` are left out."""
    newest = files.groupBy(folder).agg(F.max(mtime).alias("latest")).orderBy(F.col("latest").desc(), F.col(folder)).limit(most)
    return files.join(F.broadcast(newest.select(folder)), folder, "left_semi").where(F.col("length") <= most_bytes)


# --- measures --------------------------------------------------------------------------------------------------------
def blocks(parsed: DataFrame, keys: list[str]) -> DataFrame:
    """keys, role, tool, kind, text, name: one row a content block of a message."""
    d = parsed.where("e.type = 'message'").select(*keys, F.col("e.message.role").alias("role"), F.coalesce("e.message.toolName", F.lit("unknown")).alias("tool"), F.explode("e.message.content").alias("b"))
    return d.select(*keys, "role", "tool", F.col("b.type").alias("kind"), F.coalesce("b.text", F.lit("")).alias("text"), F.coalesce("b.name", F.lit("unknown")).alias("name"))


def tool_calls(found: DataFrame, keys: list[str]) -> DataFrame:
    return found.where("kind = 'toolCall'").groupBy(*keys, "name").agg(F.count("*").alias("calls"))


def tool_output(found: DataFrame, keys: list[str]) -> DataFrame:
    """keys, tool, chars, for each tool and, with tool null, for all of them."""
    shown = found.where("role = 'toolResult' AND kind = 'text'").select(*keys, "tool", F.length("text").alias("n"))
    every = shown.groupBy(*keys, "tool").agg(F.sum("n").alias("chars"))
    return every.unionByName(every.groupBy(*keys).agg(F.sum("chars").alias("chars")).withColumn("tool", F.lit(None).cast("string")))


def search_modes(found: DataFrame, keys: list[str], tool: str = "code_search", mark: str = "[code_search") -> DataFrame:
    """keys, header, prose_lines of each search result: its first line where it is a mark, and lines on prose files."""
    d = found.where((F.col("role") == "toolResult") & (F.col("kind") == "text") & (F.col("tool") == tool))
    lines = F.split("text", "\n", -1)
    head = F.element_at(lines, 1)
    return d.select(*keys, F.when(F.startswith(head, F.lit(mark)), head).alias("header"), F.size(F.filter(lines, lambda x: x.rlike(PROSE_LINE))).cast("long").alias("prose_lines"))


def measured(parsed: DataFrame, keys: list[str]) -> DataFrame:
    """One row a session: calls and chars (maps by tool), total_chars, modes, prose_lines."""
    found = blocks(parsed, keys)
    as_map = lambda k, v: F.map_from_entries(F.array_sort(F.collect_list(F.struct(k, v))))
    calls = tool_calls(found, keys).groupBy(*keys).agg(as_map("name", "calls").alias("calls"))
    chars = tool_output(found, keys).where("tool IS NOT NULL").groupBy(*keys).agg(as_map("tool", "chars").alias("chars"), F.sum("chars").alias("total_chars"))
    modes = search_modes(found, keys).groupBy(*keys).agg(F.array_sort(F.collect_list("header")).alias("modes"), F.sum("prose_lines").alias("prose_lines"))
    return calls.join(chars, keys, "full_outer").join(modes, keys, "full_outer")


def usage_totals(parsed: DataFrame, keys: list[str]) -> DataFrame:
    """keys, tokens_in, tokens_out, cost over the assistant's messages; what is missing counts 0."""
    d = parsed.where("e.type = 'message' AND e.message.role = 'assistant' AND e.message.usage IS NOT NULL")
    zero = lambda c: F.sum(F.coalesce(c, F.lit(0.0)))
    return d.groupBy(*keys).agg(zero("e.message.usage.input").alias("tokens_in"), zero("e.message.usage.output").alias("tokens_out"), zero("e.message.usage.cost.total").alias("cost"))


# --- repair ----------------------------------------------------------------------------------------------------------
def repair_line(line: str) -> str:
    """The line with a cost of 0 where a usage has none; any other line, malformed ones too, byte for byte as it was."""
    try:
        entry = json.loads(line)
    except ValueError:
        return line
    if not isinstance(entry, dict):
        return line
    holder = entry if entry.get("type") in ("compaction", "branch_summary") else entry.get("message") if entry.get("type") == "message" else None
    usage = holder.get("usage") if isinstance(holder, dict) else None
    if not isinstance(usage, dict) or not usage:
        return line
    cost = usage.get("cost")
    total = cost.get("total") if isinstance(cost, dict) else None
    if isinstance(total, int | float) and not isinstance(total, bool):
        return line
    usage["cost"] = dict(NO_COST)
    return json.dumps(entry, ensure_ascii=False, separators=(",", ":"))


def _repair_texts(it: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """A whole file's text with its line ends as they were, and how many entries were repaired."""
    for texts in it:
        out = []
        for text in texts:
            parts = (text or "").split("\n")
            fixed = [repair_line(p[:-1]) + "\r" if p.endswith("\r") else repair_line(p) for p in parts]
            out.append(("\n".join(fixed), sum(a != b for a, b in zip(parts, fixed, strict=True))))
        yield pd.DataFrame(out, columns=["text", "n"])


def repair_text(content: Column | str) -> Column:
    return F.pandas_udf(_repair_texts, "text string, n long")(content)


def repaired(files: DataFrame, most_bytes: int = MOST_FILE_BYTES) -> DataFrame:
    """path, was (hash), text, n, state (skipped, clean or candidate) of files (path, content)."""
    small = F.octet_length("content") <= most_bytes
    d = files.withColumn("r", F.when(small, repair_text("content")))
    state = F.when(F.col("r").isNull(), "skipped").when(F.col("r.n") == 0, "clean").otherwise("candidate")
    return d.select("path", F.sha2(F.col("content").cast("binary"), 256).alias("was"), F.coalesce("r.text", "content").alias("text"), F.coalesce("r.n", F.lit(0)).cast("long").alias("n"), state.alias("state"))


def to_write(repairs: DataFrame, current: DataFrame) -> DataFrame:
    """Candidates whose file is still what was read: path, text, backup. Others changed meanwhile and are skipped."""
    now = current.select("path", "content", F.sha2(F.col("content").cast("binary"), 256).alias("now"))
    d = repairs.where("state = 'candidate'").join(now, "path").where("was = now")
    return d.select("path", "text", F.col("content").alias("backup"), "n")


def repair_stats(repairs: DataFrame, written: DataFrame | None = None) -> DataFrame:
    """One row: scanned, candidates, repaired, entries, skipped, dry_run."""
    one = repairs.agg(F.count("*").alias("scanned"), F.count_if(F.col("state") == "candidate").alias("candidates"), F.count_if(F.col("state") == "skipped").alias("skipped"), F.coalesce(F.sum("n"), F.lit(0)).alias("entries_found"))
    if written is None:
        return one.select("scanned", "candidates", F.lit(0).cast("long").alias("repaired"), F.col("entries_found").alias("entries"), "skipped", F.lit(True).alias("dry_run"))
    done = written.agg(F.count("*").alias("repaired"), F.coalesce(F.sum("n"), F.lit(0)).alias("entries"))
    return one.crossJoin(done).select("scanned", "candidates", "repaired", "entries", (F.col("skipped") + F.col("candidates") - F.col("repaired")).alias("skipped"), F.lit(False).alias("dry_run"))


def role_totals(turns: DataFrame, keys: list[str]) -> DataFrame:
    """keys, role, turns, chars of plain conversation tables."""
    return turns.groupBy(*keys, "role").agg(F.count("*").alias("turns"), F.sum(F.length("text")).alias("chars"))


def debounced(events: DataFrame, keys: list[str], ts: str = "ts", gap_ms: int = 500, cap_ms: int | None = None) -> DataFrame:
    """keys, first, last, n: bursts of events no ``gap_ms`` apart; ``cap_ms`` also closes a burst that lasts so long."""
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    d = events.select(*keys, ts, micros.alias("at"))
    w = Window.partitionBy(*keys).orderBy("at")
    opens = F.when(F.col("at") - F.lag("at").over(w) < gap_ms * 1000, 0).otherwise(1)
    d = d.withColumn("opens", opens).withColumn("burst", F.sum("opens").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    if cap_ms is None:
        return d.groupBy(*keys, "burst").agg(F.min(ts).alias("first"), F.max(ts).alias("last"), F.count("*").alias("n")).drop("burst")
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<a: bigint, z: bigint, n: bigint>>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        last = F.element_at(a["out"], -1)
        one = lambda s, e, n: F.struct(s.alias("a"), e.alias("z"), n.cast("long").alias("n"))
        new = F.concat(a["out"], F.array(one(x, x, F.lit(1))))
        grown = F.concat(F.slice(a["out"], 1, F.size(a["out"]) - 1), F.array(one(last["a"], x, last["n"] + 1)))
        return F.struct(x.alias("at"), F.when((F.size(a["out"]) == 0) | (x - last["a"] >= cap_ms * 1000), new).otherwise(grown).alias("out"))

    g = d.groupBy(*keys, "burst").agg(F.array_sort(F.collect_list("at")).alias("ats"))
    cut = g.select(*keys, F.explode(F.aggregate("ats", start, step, lambda a: a["out"])).alias("x"))
    return cut.select(*keys, F.timestamp_micros("x.a").alias("first"), F.timestamp_micros("x.z").alias("last"), F.col("x.n").alias("n"))

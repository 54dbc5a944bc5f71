"""Edits by anchors, checks after an edit, and the mending of broken JSON and delimiters."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lines import line_hashes, lines_of, parse_anchor
from ..functions.text import compact_message
from .intervals import overlaps

# Fixed values.
MOST_FINDINGS = 5
UNCERTAIN = ("unavailable", "inconclusive", "timeout")


# --- anchors ---------------------------------------------------------------------------------------------------------
def checked_anchors(edits: DataFrame, files: DataFrame) -> DataFrame:
    """``edits`` (path, i, pos, end, lines) with start, stop and error. ``files``: path, content.

    An anchor's hash must be the line's own; a mismatch never moves to a neighbour, and five lines round it are told.
    """
    seen = files.select("path", "content", line_hashes("content").alias("marks"))
    d = edits.withColumns({"p": parse_anchor("pos"), "e": parse_anchor("end")}).join(seen, "path", "left")
    n = F.size(lines_of("content"))
    d = d.withColumns({"start": F.col("p.line"), "stop": F.when(F.col("end").isNull(), F.col("p.line")).otherwise(F.col("e.line"))})
    differs = lambda a, at: F.col(f"{a}.hash").isNotNull() & (F.try_element_at("marks", F.col(at).cast("int")) != F.col(f"{a}.hash"))
    tell = lambda a, at: F.concat(F.lit("stale anchor at line "), F.col(at).cast("string"), F.lit(": "), F.array_join(F.slice(lines_of("content"), F.greatest(F.lit(1), F.col(at).cast("int") - 2), 5), "\n"))
    error = (
        F.when(F.col("content").isNull(), "no such file").when(F.col("pos").isNull(), "missing anchor").when(F.col("p").isNull() | (F.col("end").isNotNull() & F.col("e").isNull()), "bad anchor")
        .when((F.col("start") < 1) | (F.col("start") > n), "start is out of bounds").when((F.col("stop") < F.col("start")) | (F.col("stop") > n), "end is out of bounds")
        .when(differs("p", "start"), tell("p", "start")).when(differs("e", "stop"), tell("e", "stop"))
    )
    return d.withColumn("error", error).drop("p", "e", "marks")


def apply_anchors(edits: DataFrame, files: DataFrame) -> DataFrame:
    """path, ok, error, new_content: all edits of a file, or none if one fails or two overlap.

    Lines that stay and lines that come are put together by where they begin; nothing is changed in place.
    """
    checked = checked_anchors(edits, files)
    good = checked.where("error IS NULL")
    clash = overlaps(good.select("path", "i", "start", "stop"), ["path"]).select("path").distinct().withColumn("clash", F.lit("edits overlap"))
    spans = F.array_sort(F.collect_list(F.when(F.col("error").isNull(), F.struct("start", "stop", "lines"))))
    g = checked.groupBy("path").agg(F.min("error").alias("error"), F.first("content").alias("content"), spans.alias("spans")).join(clash, "path", "left")
    lines = F.transform(lines_of("content"), lambda x, i: F.struct((i + 1).cast("long").alias("at"), F.array(x).alias("text")))
    stay = F.filter(lines, lambda x: ~F.exists("spans", lambda s: (x["at"] >= s["start"]) & (x["at"] <= s["stop"])))
    come = F.transform("spans", lambda s: F.struct(s["start"].alias("at"), s["lines"].alias("text")))
    new = F.array_join(F.flatten(F.transform(F.array_sort(F.concat(stay, come)), lambda x: x["text"])), "\n")
    error = F.coalesce("error", "clash")
    return g.select("path", error.isNull().alias("ok"), error.alias("error"), F.when(error.isNull(), new).otherwise(F.col("content")).alias("new_content"))


# --- verification ----------------------------------------------------------------------------------------------------
def diagnostics_by_severity(findings: DataFrame, keys: list[str]) -> DataFrame:
    return findings.groupBy(*keys, F.coalesce("severity", F.lit("error")).alias("severity")).agg(F.count("*").alias("n"))


def verification(edits: DataFrame, findings: DataFrame, keys: list[str]) -> DataFrame:
    """keys, state, text. ``edits``: keys, applied, syntax (state), message, reason, target. ``findings``: keys, seq, severity,
    line, col, message."""
    w = Window.partitionBy(*keys).orderBy("seq")
    place = F.when(F.col("line").isNull(), F.lit("")).when(F.col("col").isNull(), F.concat(F.lit("["), F.col("line").cast("string"), F.lit("] "))).otherwise(F.concat(F.lit("["), F.col("line").cast("string"), F.lit(":"), F.col("col").cast("string"), F.lit("] ")))
    f = findings.withColumn("nth", F.row_number().over(w)).withColumn("row", F.concat(F.lit("  - "), place, compact_message("message")))
    error = F.coalesce("severity", F.lit("error")) == "error"
    g = f.groupBy(*keys).agg(F.count("*").alias("n"), F.max(error).alias("errors"), F.array_sort(F.collect_list(F.when(F.col("nth") <= MOST_FINDINGS, F.struct("nth", "row")))).alias("rows"))
    d = edits.join(g, keys, "left").withColumns({"n": F.coalesce("n", F.lit(0)), "errors": F.coalesce("errors", F.lit(False))})
    failed, unsure = F.col("syntax") == "failed", F.col("syntax").isin(*UNCERTAIN)
    state = F.when(~F.col("applied"), "not applied").when(failed, "syntax failed").when(unsure, "syntax uncertain").when(F.col("errors"), "errors").when(F.col("n") > 0, "warnings").when(F.col("syntax") == "clean", "clean").otherwise("unchecked")
    done = F.when(F.length("target") > 0, F.concat(F.lit("Successfully applied edit to "), F.col("target"), F.lit("."))).otherwise(F.lit("Successfully applied edit."))
    bullet = lambda c: F.when(F.length(c) > 0, F.concat(F.lit("\n  - "), compact_message(c))).otherwise(F.lit(""))
    refused = F.concat(F.lit("Edit: Not applied\nReason:"), bullet("reason"), F.when(F.col("message").eqNullSafe(F.col("reason")), F.lit("")).otherwise(bullet("message")))
    syntax = F.when(failed | unsure, F.concat(F.lit("\nSyntax Error:\n  - "), compact_message(F.coalesce(F.nullif("message", F.lit("")), F.lit("Syntax validation failed"))))).otherwise(F.lit(""))
    found = F.when(F.col("n") > 0, F.concat(F.when(F.col("errors"), "\nDiagnostics (errors):\n").otherwise("\nDiagnostics (warnings):\n"), F.array_join(F.transform("rows", lambda x: x["row"]), "\n"), F.when(F.col("n") > MOST_FINDINGS, F.concat(F.lit("\n  - +"), (F.col("n") - MOST_FINDINGS).cast("string"), F.lit(" more"))).otherwise(F.lit("")))).otherwise(F.lit(""))
    text = F.when(state == "not applied", refused).when(state.isin("clean", "unchecked"), done).otherwise(F.concat(F.lit("Edit: Applied"), syntax, found))
    return d.select(*keys, state.alias("state"), text.alias("text"))


# --- mending ---------------------------------------------------------------------------------------------------------
_CLOSER = {"{": "}", "(": ")", "[": "]"}
# strings with escapes, comments (open ones too), or one delimiter
_CODE = re.compile(r"""(?s)'(?:\\.|[^'\\])*(?:'|\Z)|"(?:\\.|[^"\\])*(?:"|\Z)|`(?:\\.|[^`\\])*(?:`|\Z)|//[^\n]*|/\*.*?(?:\*/|\Z)|([{}()\[\]])""")
_JSON = re.compile(r"""(?s)"(?:\\.|[^"\\])*(?:"|\Z)|([{}\[\]])""")


def _open(text: str, pattern: re.Pattern) -> list[str]:
    """Opening delimiters without their closing ones; a closing one that fits none is passed over."""
    stack: list[str] = []
    for m in pattern.finditer(text):
        c = m[1]
        if c in _CLOSER:
            stack.append(c)
        elif c and stack and _CLOSER[stack[-1]] == c:
            stack.pop()
    return stack


def missing_delimiters(text: str) -> list[str]:
    """Closing delimiters that the text lacks, innermost first."""
    return [_CLOSER[c] for c in reversed(_open(text, _CODE))]


def heal_json(text: str) -> str | None:
    """The text if it is JSON; else with its open brackets closed, if that makes it so; else null."""
    strict = json.JSONDecoder(parse_constant=lambda x: (_ for _ in ()).throw(ValueError(x)))
    try:
        strict.decode(text)
        return text
    except (ValueError, RecursionError):
        pass
    opened = _open(text, _JSON)
    if not opened:
        return None
    healed = text.rstrip().removesuffix(",") + "".join("\n" + _CLOSER[c] for c in reversed(opened))
    try:
        strict.decode(healed)
        return healed
    except (ValueError, RecursionError):
        return None


# Words after which a slash begins a pattern, as after an operator; after a value it divides.
_BEFORE_PATTERN = frozenset("return typeof case in of delete void throw new else do await yield instanceof".split())
_OPERATORS = frozenset("(,=:[!&|?{};+-*%<>~^")
_PIECE = re.compile(r"""(?s)(?P<note>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<text>'(?:\\.|[^'\\])*(?:'|\Z)|"(?:\\.|[^"\\])*(?:"|\Z)|`(?:\\.|[^`\\])*(?:`|\Z))|(?P<slash>/)|(?P<word>[\w$]+)|(?P<mark>\S)""")
_PATTERN = re.compile(r"/(?:\\[^\n]|\[(?:\\[^\n]|[^\]\\\n])*\]|[^/\\\[\n])+/\w*")


def code_delimiters(text: str) -> Iterator[tuple[str, int]]:
    """Delimiters of code with their offsets; those in strings, comments and regular-expression literals aren't code."""
    at, before = 0, ""
    while m := _PIECE.search(text, at):
        at, kind = m.end(), m.lastgroup
        if kind == "note":
            continue
        if kind == "slash" and (not before or before in _BEFORE_PATTERN or before in _OPERATORS) and (literal := _PATTERN.match(text, m.start())):
            at, before = literal.end(), "//"
            continue
        if kind == "mark" and m[0] in "{}()[]":
            yield m[0], m.start()
        before = '""' if kind == "text" else m[0]


def structure_error(text: str) -> str | None:
    """What is out of balance in code: a closing delimiter without its opening one, or an opening one that stays open."""
    stack: list[tuple[str, int]] = []
    line = seen = 0
    for c, at in code_delimiters(text):
        line, seen = line + text.count("\n", seen, at), at
        if c in _CLOSER:
            stack.append((c, line + 1))
        elif not stack or _CLOSER[stack[-1][0]] != c:
            return f"line {line + 1}: unexpected {c}"
        else:
            stack.pop()
    return f"line {stack[-1][1]}: {stack[-1][0]} is not closed" if stack else None


def _each(f):
    def run(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for xs in it:
            yield pd.Series([None if x is None else f(x) for x in xs], dtype=object)

    return run


def healed_json(text: Column | str) -> Column:
    return F.pandas_udf(_each(heal_json), "string")(text)


def unclosed(text: Column | str) -> Column:
    return F.pandas_udf(_each(missing_delimiters), "array<string>")(text)


def structure(text: Column | str) -> Column:
    return F.pandas_udf(_each(structure_error), "string")(text)

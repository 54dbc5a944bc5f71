"""String functions of the search and log planes, as column expressions.

Lengths are code points; for ASCII they equal UTF-16 units. White space is what ``\\s`` matches with Unicode on.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values ----------------------------------------------------------------------------------------------------
STOPWORDS = ("a", "an", "the", "and", "or", "in", "on", "at", "to", "for", "with", "by", "of", "is", "as", "it", "from", "be")
KINDS = ("file", "function", "class", "interface", "type", "enum", "variable", "constant", "method", "alias", "test")
EXTENSIONS = (".ts", ".tsx", ".js", ".jsx", ".py", ".rs", ".go", ".c", ".cpp", ".h", ".hpp", ".java", ".cs", ".rb", ".php", ".swift", ".sh", ".bash", ".sql")
TEST_PATH_PARTS = ("/test/", "/tests/", "/__tests__/", "/spec/", "/specs/", "test_", "_test.", ".test.", ".spec.")
TEST_PATH_STARTS = ("test/", "tests/", "spec/")
DISCOVERY_TOOLS = ("grep", "find", "rg", "ripgrep", "locate", "where", "which", "tree", "ls", "dir")
DISCOVERY_ANYWHERE = r"\b(grep|find|rg|tree|ls)\b"
EXECUTION = r"\b(test|vitest|jest|pytest|ava|mocha|cargo|tsc|build|check)\b"
DIAGNOSTICS_ON_ERROR = (r"^\s*(?:FAIL|✕|×)\s+\S+", r"\bAssertionError:\s", r"\berror\[E\d+\]:\s", r"\b(?:TypeError|SyntaxError|ReferenceError|Error):\s", r"-->\s+\S+:\d+:\d+")
DIAGNOSTICS_UNFLAGGED = (r"^\s*(?:FAIL|✕|×)\s+\S+", r"-->\s+\S+:\d+:\d+", r"^\s*error\[E\d+\]:\s")
SIGNATURE_WIDTH, MESSAGE_WIDTH, EMBEDDED_CHARS = 220, 240, 1500
# ---------------------------------------------------------------------------------------------------------------------


def as_col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def trim_space(x: Column | str) -> Column:
    return F.regexp_replace(as_col(x), r"(?U)^\s+|\s+$", "")


def trim_end(x: Column | str) -> Column:
    return F.regexp_replace(as_col(x), r"(?U)\s+\z", "")


def tokens(text: Column | str) -> Column:
    """Code-aware tokens: each word in lower case, then its ``_`` parts, then its camel parts; two characters at least."""
    text = F.coalesce(as_col(text), F.lit(""))
    words = F.regexp_extract_all(text, F.lit("([a-zA-Z0-9_]+)"), F.lit(1))
    none = F.array().cast("array<string>")
    lowered = lambda xs: F.transform(xs, lambda x: F.lower(x))

    def parts(w: Column) -> Column:
        snake = F.when(F.contains(w, F.lit("_")), lowered(F.split(w, "_", -1))).otherwise(none)
        camel = F.when(w.rlike("[a-z][A-Z]"), lowered(F.split(F.regexp_replace(w, "([a-z])([A-Z])", "$1 $2"), " ", -1))).otherwise(none)
        return F.concat(F.array(F.lower(w)), snake, camel)

    every = F.filter(F.flatten(F.transform(words, parts)), lambda t: F.length(t) >= 2)
    # prose has words without parts: then lowering comes first, unless a character beyond ASCII would turn into a letter
    prose = ~text.rlike("_|[a-z][A-Z]|[\u0130\u212A]")
    return F.when(prose, F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]{2,})"), F.lit(1))).otherwise(every)


def query_tokens(text: str) -> list[str]:
    """The same rule for a query on the driver, in order."""
    import re

    out: list[str] = []
    for word in re.findall("[a-zA-Z0-9_]+", text or ""):
        camel = re.sub("([a-z])([A-Z])", r"\1 \2", word).split(" ")
        out += [p.lower() for p in [word, *(word.split("_") if "_" in word else []), *(camel if len(camel) > 1 else [])] if len(p) >= 2]
    return out


def query_terms(text: str) -> list[str]:
    """Distinct tokens without stop words, in order; all of them where nothing else is left."""
    every = query_tokens(text)
    return list(dict.fromkeys([t for t in every if t not in STOPWORDS] or every))


def without_stopwords(terms: Column | str) -> Column:
    rest = F.filter(as_col(terms), lambda t: ~t.isin(*STOPWORDS))
    return F.when(F.size(rest) > 0, rest).otherwise(as_col(terms))


def identifiers(text: Column | str) -> Column:
    """Distinct identifiers of three characters at least."""
    return F.array_distinct(F.regexp_extract_all(as_col(text), F.lit(r"\b([a-zA-Z_]\w{2,})\b"), F.lit(1)))


# --- paths -----------------------------------------------------------------------------------------------------------
def forward_slashes(path: Column | str) -> Column:
    return F.replace(as_col(path), F.lit("\\"), F.lit("/"))


def path_contains(path: Column | str, pattern: str | None) -> Column:
    """Case-blind substring of the path; an absent or empty pattern passes all."""
    if not pattern:
        return F.lit(True)
    return F.contains(F.lower(forward_slashes(path)), F.lit(pattern.replace("\\", "/").lower()))


def extension(path: Column | str) -> Column:
    """Extension of the last part, with its dot; empty where there is none or the name only begins with a dot."""
    return F.regexp_extract(F.regexp_extract(forward_slashes(path), r"([^/]*)$", 1), r"(?s)[^.].*?(\.[^.]*)$", 1)


def language_of(path: Column | str) -> Column:
    name = F.substring(extension(path), 2, 100)
    return F.when(F.length(name) > 0, name).otherwise(F.lit("text"))


def is_indexable(path: Column | str) -> Column:
    return F.lower(extension(path)).isin(*EXTENSIONS)


def is_known_kind(kind: Column | str) -> Column:
    return as_col(kind).isin(*KINDS)


def is_safe_path(path: Column | str) -> Column:
    """Relative, with no NUL, colon or backslash and no empty, ``.`` or ``..`` part."""
    p = as_col(path)
    return (F.length(p) > 0) & ~p.rlike(r"[\x00:\\]") & F.forall(F.split(p, "/", -1), lambda x: ~x.isin("", ".", ".."))


def normal_path(path: Column | str) -> Column:
    """An absolute path without empty, ``.`` and ``..`` parts."""
    start = F.array().cast("array<string>")

    def step(done: Column, x: Column) -> Column:
        return F.when(x.isin("", "."), done).when(x == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(x)))

    return F.concat(F.lit("/"), F.array_join(F.aggregate(F.split(forward_slashes(path), "/", -1), start, step), "/"))


def is_inside(path: Column | str, roots: Column | list[str]) -> Column:
    """Whether an absolute path is one of the roots, the workspace or a temporary folder, or lies below one; by names alone."""
    p = normal_path(path)
    of = F.array(*(F.lit(r) for r in roots)) if isinstance(roots, list) else roots
    return F.startswith(forward_slashes(path), F.lit("/")) & F.exists(of, lambda r: (p == normal_path(r)) | F.startswith(p, F.concat(F.regexp_replace(normal_path(r), "/$", ""), F.lit("/"))))


def is_test_path(path: Column | str) -> Column:
    p = F.lower(forward_slashes(path))
    out = F.lit(False)
    for x in TEST_PATH_PARTS:
        out = out | F.contains(p, F.lit(x))
    for x in TEST_PATH_STARTS:
        out = out | F.startswith(p, F.lit(x))
    return out


# --- chunks ----------------------------------------------------------------------------------------------------------
def content_hash(content: Column | str, width: int = 16) -> Column:
    return F.substring(F.sha2(as_col(content).cast("binary"), 256), 1, width)


def chunk_id(path: Column, start: Column, end: Column, symbol: Column | None = None) -> Column:
    base = F.concat(path, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"))
    return base if symbol is None else F.concat(base, F.when(F.length(symbol) > 0, F.concat(F.lit("#"), symbol)).otherwise(F.lit("")))


def breadcrumb(path: Column, parent: Column, kind: Column, name: Column) -> Column:
    inside = F.when(parent.isNotNull(), F.concat(F.lit(" > [Class: "), parent, F.lit("]"))).otherwise(F.lit(""))
    return F.concat(F.lit("// [File: "), path, F.lit("]"), inside, F.lit(" > ["), F.upper(kind), F.lit(": "), name, F.lit("]"))


def embedded_text(crumb: Column, content: Column, signature: Column | None = None) -> Column:
    head = F.lit("\n") if signature is None else F.concat(F.lit("\nSignature: "), signature, F.lit("\n\n"))
    return F.concat(crumb, head, F.substring(content, 1, EMBEDDED_CHARS))


def weighted_fields(name: Column, signature: Column, crumb: Column, content: Column) -> Column:
    """The text that is indexed: the name counts twice."""
    return F.concat_ws(" ", name, name, signature, crumb, content)


# --- shaping ---------------------------------------------------------------------------------------------------------
def shortened(text: Column, width: int, kept: int) -> Column:
    return F.when(F.length(text) > width, F.concat(F.substring(text, 1, kept), F.lit("..."))).otherwise(text)


def compact_signature(signature: Column | str) -> Column:
    flat = trim_space(F.regexp_replace(F.coalesce(as_col(signature), F.lit("")), r"(?U)\s+", " "))
    return shortened(flat, SIGNATURE_WIDTH, SIGNATURE_WIDTH - 3)


def compact_message(message: Column | str) -> Column:
    flat = trim_space(F.regexp_replace(F.coalesce(as_col(message), F.lit("")), r"(?U)\s+", " "))
    return F.when(F.length(flat) > MESSAGE_WIDTH, F.concat(F.substring(flat, 1, MESSAGE_WIDTH - 1), F.lit("…"))).otherwise(flat)


def clip_to_budget(text: Column, budget: Column | int) -> Column:
    b = F.lit(budget) if isinstance(budget, int) else budget
    return F.when(F.length(text) <= b, text).when(b <= 40, F.substr(text, F.lit(1), b)).otherwise(F.concat(F.substr(text, F.lit(1), b - 27), F.lit("\n... output clipped ...")))


def clamp_width(line: Column | str, number: Column, width: int = 300) -> Column:
    """A long line keeps its start and says how many characters are missing. ``number`` counts from 1."""
    line, kept = as_col(line), max(10, width - 60)
    note = F.concat(F.substring(line, 1, kept), F.lit("... <line "), number.cast("string"), F.lit(" truncated: "), F.format_number(F.length(line) - F.lit(kept), 0), F.lit(" chars omitted>"))
    return F.when(F.length(line) > width, note).otherwise(line)


def strip_ansi(text: Column | str) -> Column:
    return F.regexp_replace(as_col(text), r"\x1b\[[0-9;]*[A-Za-z]", "")


def visible_width(text: Column | str) -> Column:
    return F.length(strip_ansi(text))


def truncate_to_width(text: Column | str, width: int) -> Column:
    plain = strip_ansi(text)
    return F.when(F.length(plain) > width, F.concat(F.substring(plain, 1, max(0, width - 1)), F.lit("…"))).otherwise(plain)


def with_line_ends(text: Column, crlf: Column) -> Column:
    """Line ends as the file had them: all CRLF or all LF."""
    lf = F.replace(text, F.lit("\r\n"), F.lit("\n"))
    return F.when(crlf, F.replace(lf, F.lit("\n"), F.lit("\r\n"))).otherwise(lf)


def first_few(items: Column, n: int, one: str = "more") -> Column:
    """``a, b`` of the first n, with ``+k more`` for the rest."""
    rest = F.size(items) - F.lit(n)
    return F.concat(F.array_join(F.slice(items, 1, n), ", "), F.when(rest > 0, F.concat(F.lit(" +"), rest.cast("string"), F.lit(f" {one}"))).otherwise(F.lit("")))


# --- commands and numbers --------------------------------------------------------------------------------------------
def is_discovery_command(command: Column | str) -> Column:
    c = F.lower(trim_space(F.coalesce(as_col(command), F.lit(""))))
    return F.regexp_extract(c, r"^(\S*)", 1).isin(*DISCOVERY_TOOLS) | c.rlike(DISCOVERY_ANYWHERE)


def is_execution_command(command: Column | str) -> Column:
    return F.lower(F.coalesce(as_col(command), F.lit(""))).rlike(EXECUTION)


def is_diagnostic(line: Column | str, flagged: bool) -> Column:
    out = F.lit(False)
    for pattern in DIAGNOSTICS_ON_ERROR if flagged else DIAGNOSTICS_UNFLAGGED:
        out = out | as_col(line).rlike(pattern)
    return out


def _fixed1(x: Column) -> Column:
    return F.format_string("%.1f", F.round(x, 1))


def format_count(n: Column | str) -> Column:
    """999, 1.2k, 45k, 1.2M."""
    x = as_col(n).cast("double")
    whole = lambda v: F.floor(v + 0.5).cast("string")
    return (
        F.when(x.isNull() | F.isnan(x) | (x < 0) | (x == float("inf")), F.lit("0"))
        .when(x < 1000, F.when(x == F.floor(x), F.floor(x).cast("string")).otherwise(x.cast("string")))
        .when(x < 10_000, F.concat(_fixed1(x / 1000), F.lit("k")))
        .when(x < 1_000_000, F.concat(whole(x / 1000), F.lit("k")))
        .when(x < 10_000_000, F.concat(_fixed1(x / 1_000_000), F.lit("M")))
        .otherwise(F.concat(whole(x / 1_000_000), F.lit("M")))
    )


def load_level(percent: Column | str) -> Column:
    p = as_col(percent)
    return F.when(p > 90, "critical").when(p > 70, "warning").otherwise("good")

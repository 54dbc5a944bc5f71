"""The evidence ledger: what a session has seen of a file, and whether that authorises a change.

Evidence: session, path, kind (read or search), fingerprint, complete, ranges (merged, array of start and stop), total,
provenance, query, hits (array of line and text).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.lines import lines_of
from ..functions.text import is_safe_path, strip_ansi, trim_space
from .intervals import from_points, merge

# Fixed values.
READERS = ("cat", "head", "tail", "sed", "awk", "grep", "rg", "less", "more")
PATTERN_FIRST = ("grep", "rg", "awk", "sed")
NO_CONTENT_LONG = ("--count", "--files-with-matches", "--files-without-match", "--quiet", "--silent")
NO_CONTENT_SHORT = "^-[^-]*[clLq]"
REDIRECTS = (">", ">>", "<", "2>", "2>&1")
PROVENANCES = ("read", "batch_read", "search", "shell", "write", "edit", "restored")
ONE_FILE = r"^(\d+)([:-])(.*)$"
HIT_LINE = r"^((?:[a-zA-Z]:[\\/])?[^:\r\n]+):(\d+):(?:\d+:)?(.*)$"
CONTEXT_LINE = r"^((?:[a-zA-Z]:[\\/])?[^:\r\n]+?\.[a-zA-Z0-9_]+)-(\d+)-(.*)$"
CONTEXT_BARE = r"^((?:[a-zA-Z]:[\\/])?[^:\r\n]+?)-(\d+)-(.*)$"
TRACE_NAMED = r"""(?i)(?:-->|\s+at|\s+❯|File\s+["']?)\s*([^\s"(),]+\.[a-zA-Z0-9]+)(?:["']?)(?:[:(]|\s*,?\s*line\s+)(\d+)"""
TRACE_BARE = r"(?:^|[\s(])([^\s()]+\.[a-zA-Z0-9]+)[:(](\d+)(?:[:,\s)]|$)"
PAGED_HEAD, PAGED_TAIL, PAGED_SED = r"(?i)\bhead\b.*?-n\s*(\d+)", r"(?i)\btail\b.*?-n\s*(\d+)", r"(?i)\bsed\b.*?-n\s*['\"]?(\d+),(\d+)p['\"]?"
MOST_RECORDS, MOST_STATE_BYTES = 1000, 2 * 1024 * 1024
EVIDENCE = "path string, kind string, fingerprint string, complete boolean, ranges array<struct<start: bigint, stop: bigint>>, total bigint, provenance string, query string, hits array<struct<line: bigint, text: string>>, session string"
RANGES = "array<struct<start: bigint, stop: bigint>>"


# --- commands and their output ---------------------------------------------------------------------------------------
def inspected_files(commands: DataFrame, keys: list[str], command: str = "command") -> DataFrame:
    """keys, path: files that a shell command shows content of, in words of the command; once each."""
    parts = F.filter(F.transform(F.split(command, r"[|;&\n]+", -1), lambda x: trim_space(x)), lambda x: x != "")
    d = commands.select(*keys, F.explode(parts).alias("part"))
    words = F.regexp_extract_all("part", F.lit(r"""((?:[^\s"']+|"[^"]*"|'[^']*')+)"""), F.lit(1))
    bare = F.transform(words, lambda w: F.when(w.rlike("^\".*\"$|^'.*'$") & (F.length(w) > 1), F.substr(w, F.lit(2), F.length(w) - 2)).otherwise(w))
    d = d.withColumn("words", F.filter(bare, lambda w: w != "")).where(F.size("words") > 0)
    name = F.regexp_replace(F.lower(F.regexp_extract(F.element_at("words", 1), r"([^/\\]*)$", 1)), r"\.(exe|cmd|bat)$", "")
    rest = F.slice("words", 2, F.greatest(F.size("words") - 1, F.lit(0)))
    d = d.withColumns({"name": name, "rest": rest}).where(F.col("name").isin(*READERS))
    quiet = F.exists("rest", lambda w: w.isin(*NO_CONTENT_LONG) | w.rlike(NO_CONTENT_SHORT))
    d = d.where(~(F.col("name").isin("grep", "rg") & quiet))
    named = F.filter("rest", lambda w: ~F.startswith(w, F.lit("-")) & ~w.isin(*REDIRECTS))
    files = F.when(F.col("name").isin(*PATTERN_FIRST), F.slice(named, 2, F.greatest(F.size(named) - 1, F.lit(0)))).otherwise(named)
    return d.select(*keys, F.explode(files).alias("path")).distinct()


def resolved(path: Column, candidates: Column) -> Column:
    """The candidate that a path in a log means: itself, else the first one that ends in it."""
    ends = F.filter(candidates, lambda c: F.endswith(c, path))
    return F.when(F.array_contains(candidates, path), path).when(F.size(ends) > 0, F.element_at(ends, 1))


def parsed_log(outputs: DataFrame, keys: list[str], text: str = "text", candidates: str = "candidates") -> DataFrame:
    """keys, path, line, hit, said: lines of files that an output shows. The first rule that fits a line decides.

    With one candidate ``12:x`` is a hit and ``12-x`` context; then ``path:12:x`` and ``path-12-x``; then places in
    compiler messages and stack traces, of which two lines on either side are seen too.
    """
    d = outputs.select(*keys, F.col(candidates).alias("cs"), F.posexplode(F.split(text, r"\r?\n", -1)).alias("at", "raw"))
    d = d.withColumn("x", trim_space(strip_ansi("raw"))).where("x <> '' AND x <> '--'")
    number = lambda p, i: F.try_to_number(F.regexp_extract("x", p, i), F.lit("9999999999")).cast("long")
    one = F.col("x").rlike(ONE_FILE) & (F.size("cs") == 1)
    hit, ext = F.col("x").rlike(HIT_LINE), F.col("x").rlike(CONTEXT_LINE)
    context = ~hit & (ext | F.col("x").rlike(CONTEXT_BARE))
    pick = lambda p: F.struct(resolved(F.trim(F.regexp_extract("x", p, 1)), F.col("cs")).alias("path"), number(p, 2).alias("line"), F.trim(F.regexp_extract("x", p, 3)).alias("said"))
    d = d.withColumn("direct", F.when(one, F.struct(F.element_at("cs", 1).alias("path"), number(ONE_FILE, 1).alias("line"), F.trim(F.regexp_extract("x", ONE_FILE, 3)).alias("said"))).when(hit, pick(HIT_LINE)).when(context & ext, pick(CONTEXT_LINE)).when(context, pick(CONTEXT_BARE)))
    known = F.col("direct.path").isNotNull() & (F.col("direct.line") >= 1)
    trace = F.when(F.col("raw").rlike(TRACE_NAMED), 1).when(F.col("x").rlike(TRACE_BARE), 2)
    place = lambda p, c: F.struct(resolved(F.trim(F.regexp_extract(c, p, 1)), F.col("cs")).alias("path"), F.try_to_number(F.regexp_extract(c, p, 2), F.lit("9999999999")).cast("long").alias("line"))
    d = d.withColumn("known", F.coalesce(known, F.lit(False))).withColumn("trace", F.when(~F.col("known"), F.when(trace == 1, place(TRACE_NAMED, "raw")).when(trace == 2, place(TRACE_BARE, "x"))))
    is_hit = F.when(one, F.regexp_extract("x", ONE_FILE, 2) == ":").otherwise(hit)
    seen = d.where("known").select(*keys, "direct.path", "direct.line", is_hit.alias("hit"), F.when(is_hit, F.col("direct.said")).alias("said"))
    near = d.where("NOT known AND trace.path IS NOT NULL AND trace.line >= 1").select(*keys, "trace.path", F.col("trace.line").alias("mid"), F.explode(F.sequence(F.greatest(F.lit(1).cast("long"), F.col("trace.line") - 2), F.col("trace.line") + 2)).alias("line"))
    return seen.unionByName(near.select(*keys, "path", "line", (F.col("line") == F.col("mid")).alias("hit"), F.lit(None).cast("string").alias("said")))


def paged_lines(outputs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, start, stop: lines that head, tail or sed printed, proved by the text. Rows: keys, command, text, source."""
    clean = lambda c: F.replace(F.col(c), F.lit("\r\n"), F.lit("\n"))
    cut = lambda t: F.split(F.when(F.endswith(t, F.lit("\n")), F.substr(t, F.lit(1), F.length(t) - 1)).otherwise(t), "\n", -1)
    d = outputs.withColumns({"src": cut(clean("source")), "out": cut(clean("text"))}).withColumn("n", F.size("src"))
    num = lambda p, i: F.try_to_number(F.regexp_extract("command", p, i), F.lit("9999999999")).cast("long")
    head, tail, sed = PAGED_HEAD, PAGED_TAIL, PAGED_SED
    is_head, is_tail, is_sed = (F.col("command").rlike(p) for p in (head, tail, sed))
    start = F.when(is_head, F.lit(1)).when(is_tail, F.col("n") - F.least(num(tail, 1), F.col("n")) + 1).when(is_sed, num(sed, 1))
    stop = F.when(is_head, F.least(num(head, 1), F.col("n"))).when(is_tail, F.col("n")).when(is_sed, num(sed, 2))
    d = d.select(*keys, "src", "out", "n", start.cast("long").alias("start"), stop.cast("long").alias("stop")).where("start >= 1 AND stop >= start AND stop <= n")
    return d.where(F.slice("src", F.col("start").cast("int"), (F.col("stop") - F.col("start") + 1).cast("int")) == F.col("out")).select(*keys, "start", "stop")


def shell_observations(outputs: DataFrame, files: DataFrame) -> DataFrame:
    """What shell commands showed, as observations for ``recorded``. ``outputs``: session, seq, command, text.
    ``files``: path, content, fingerprint, of the workspace as it is.

    A command's words that name a file, or end one's path, are its candidates. Lines that its output places in one of them
    are ranges and hits; where it names one file, lines that head, tail or sed printed are proved by the file's text.
    """
    keys = ["session", "seq"]
    words = inspected_files(outputs, keys).withColumnRenamed("path", "word")
    every = files.select("path", F.element_at(F.split("path", "/", -1), -1).alias("name"))
    named = words.withColumn("name", F.element_at(F.split("word", "/", -1), -1)).join(every, "name").where((F.col("path") == F.col("word")) | F.endswith("path", F.concat(F.lit("/"), "word")))
    candidates = named.groupBy(*keys).agg(F.sort_array(F.collect_set("path")).alias("candidates"))  # as few as a command's words
    told = outputs.join(candidates, keys)
    placed = parsed_log(told, keys)
    ranges = from_points(placed, [*keys, "path"]).select(*keys, "path", F.struct("start", "stop").alias("r"))
    one = told.where(F.size("candidates") == 1).withColumn("path", F.element_at("candidates", 1)).join(files.select("path", F.col("content").alias("source")), "path")
    paged = paged_lines(one.select(*keys, "path", "command", "text", "source"), [*keys, "path"]).select(*keys, "path", F.struct("start", "stop").alias("r"))
    seen = ranges.unionByName(paged).groupBy(*keys, "path").agg(F.array_sort(F.collect_set("r")).alias("ranges"))
    hits = placed.where("hit").groupBy(*keys, "path").agg(F.array_sort(F.collect_set(F.struct("line", F.col("said").alias("text")))).alias("hits"))
    d = seen.join(hits, [*keys, "path"], "left").join(files.select("path", "fingerprint", F.size(lines_of("content")).cast("long").alias("total")), "path")
    return d.select(
        "session", "path", F.when(F.coalesce(F.size("hits"), F.lit(0)) > 0, "search").otherwise("read").alias("kind"), "fingerprint", F.lit(False).alias("complete"), F.col("ranges").cast(RANGES).alias("ranges"), "total",
        F.lit("shell").alias("provenance"), F.lit(None).cast("string").alias("query"), F.coalesce("hits", F.array().cast("array<struct<line: bigint, text: string>>")).alias("hits"), "seq",
    )


# --- recording -------------------------------------------------------------------------------------------------------
def recorded(observations: DataFrame, order: str = "seq") -> DataFrame:
    """The ledger from observations (the columns of evidence and ``order``), one row for each session and path.

    What was seen of an older content is void: only what came since the fingerprint last changed counts. A file once read
    stays read; ranges are joined, hits are kept one a line, the last one; provenance, query and total are the last.
    """
    keys = ["session", "path"]
    w = Window.partitionBy(*keys).orderBy(order)
    changed = F.when(F.lag("fingerprint").over(w).eqNullSafe(F.col("fingerprint")), 0).otherwise(1)
    d = observations.withColumn("changed", changed).withColumn("run", F.sum("changed").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    last = d.groupBy(*keys).agg(F.max("run").alias("run"))
    d = d.join(last, [*keys, "run"])
    state = d.groupBy(*keys).agg(
        F.when(F.max((F.col("kind") == "read").cast("int")) == 1, "read").otherwise("search").alias("kind"), F.max_by("fingerprint", order).alias("fingerprint"), F.max("complete").alias("complete"),
        F.max_by("total", F.when(F.col("total").isNotNull(), F.col(order))).alias("total"), F.max_by("provenance", order).alias("provenance"), F.max_by("query", F.when(F.col("query").isNotNull(), F.col(order))).alias("query"),
    )
    points = d.select(*keys, F.explode("ranges").alias("r")).select(*keys, "r.start", "r.stop").join(state.select(*keys, "total"), keys)
    ranges = merge(points, keys, "total").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("ranges"))
    hits = d.select(*keys, order, F.posexplode("hits").alias("nth", "h")).groupBy(*keys, F.col("h.line").alias("line")).agg(F.max_by("h.text", F.struct(order, "nth")).alias("text"))
    hits = hits.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("line", "text"))).alias("hits"))
    out = state.join(ranges, keys, "left").join(hits, keys, "left")
    return out.select(*keys, "kind", "fingerprint", "complete", F.coalesce("ranges", F.array().cast(RANGES)).alias("ranges"), "total", "provenance", "query", F.coalesce("hits", F.array().cast("array<struct<line: bigint, text: string>>")).alias("hits"))


def after_mutation(ledger: DataFrame, edits: DataFrame) -> DataFrame:
    """The ledger after edits (session, path, fingerprint, edit_end, delta): ranges below the edits move with the lines."""
    d = ledger.join(edits.select("session", "path", F.col("fingerprint").alias("new"), "edit_end", "delta"), ["session", "path"], "left")
    moves = lambda r: F.when(~F.col("complete") & (F.col("delta") != 0) & (r["start"] > F.col("edit_end")), F.struct((r["start"] + F.col("delta")).alias("start"), (r["stop"] + F.col("delta")).alias("stop"))).otherwise(r)
    moved = F.when(F.col("new").isNotNull(), F.transform("ranges", moves)).otherwise(F.col("ranges"))
    return d.select("session", "path", "kind", F.coalesce("new", "fingerprint").alias("fingerprint"), "complete", moved.alias("ranges"), (F.col("total") + F.coalesce("delta", F.lit(0))).alias("total"), "provenance", "query", "hits")


def restorable(stored: DataFrame, current: DataFrame, most: int = MOST_RECORDS) -> DataFrame:
    """Stored evidence that is well formed, whose file still has its content, the first ``most`` of each session."""
    ok = is_safe_path("path") & F.col("kind").isin("read", "search") & F.col("fingerprint").rlike("^[0-9a-f]{64}$") & F.col("provenance").isin(*PROVENANCES)
    ok = ok & ~(F.col("complete") & (F.col("kind") == "search")) & F.forall("ranges", lambda r: (r["start"] >= 1) & (r["stop"] >= r["start"])) & F.forall("hits", lambda h: h["line"] >= 1)
    d = stored.where(F.coalesce(ok, F.lit(False))).join(current.select("path", F.col("fingerprint").alias("now")), "path").where("fingerprint = now").drop("now")
    return d.withColumn("nth", F.row_number().over(Window.partitionBy("session").orderBy("path"))).where(F.col("nth") <= most).drop("nth").select(*stored.columns)


def storable(ledger: DataFrame, most: int = MOST_RECORDS, most_bytes: int = MOST_STATE_BYTES) -> DataFrame:
    """The evidence that a session's state keeps: well formed, the first ``most`` records by path, within ``most_bytes`` as JSON."""
    current = ledger.select("path", "fingerprint").distinct()
    d = restorable(ledger, current, most).withColumn("_bytes", F.octet_length(F.to_json(F.struct(*(F.col(c) for c in ledger.columns)))) + 1)
    total = F.sum("_bytes").over(Window.partitionBy("session").orderBy("path").rowsBetween(Window.unboundedPreceding, 0))
    return d.withColumn("_total", total).where(F.col("_total") <= most_bytes).select(*ledger.columns)


def save_state(ledger: DataFrame, folder: str, n: int) -> None:
    """State number ``n``: a folder of its own, so the one before stays until this one is whole."""
    storable(ledger).write.mode("overwrite").partitionBy("session").parquet(f"{folder}/state{n}")


def load_state(spark: SparkSession, folder: str, n: int, current: DataFrame, session: str | None = None) -> DataFrame:
    """Evidence of state ``n`` that still holds; with ``session``, only that session's part is read."""
    d = spark.read.option("basePath", f"{folder}/state{n}").schema(EVIDENCE).parquet(f"{folder}/state{n}")
    return restorable(d if session is None else of_session(d, session), current)


def of_session(ledger: DataFrame, session: str) -> DataFrame:
    return ledger.where(F.col("session") == session)


def without_session(ledger: DataFrame, session: str, path: str | None = None) -> DataFrame:
    gone = F.col("session") == session
    return ledger.where(~(gone if path is None else gone & (F.col("path") == path)))


# --- authorisation ---------------------------------------------------------------------------------------------------
def _substantive(block: Column) -> Column:
    lines = F.filter(F.transform(lines_of(F.replace(block, F.lit("\r\n"), F.lit("\n"))), lambda x: trim_space(x)), lambda x: x != "")
    return (F.size(lines) >= 2) & (F.aggregate(lines, F.lit(0), lambda a, x: a + F.length(x)) >= 35)


def _covers(ranges: Column, t: Column) -> Column:
    return F.exists(ranges, lambda r: (r["start"] <= t["start"]) & (r["stop"] >= t["stop"]))


def _first_hit_close(hits: Column, t: Column) -> Column:
    """The first hit inside lies near both ends of a short range."""
    h = F.try_element_at(F.filter(hits, lambda h: (h["line"] >= t["start"]) & (h["line"] <= t["stop"])), F.lit(1))["line"]
    return F.coalesce((h - t["start"] <= 3) & (t["stop"] - h <= 3) & (t["stop"] - t["start"] + 1 <= 10), F.lit(False))


def _adjacent(hits: Column, t: Column) -> Column:
    return F.exists(hits, lambda h: (F.abs(t["start"] - h["line"]) <= 2) | (F.abs(t["stop"] - h["line"]) <= 2)) & (t["stop"] - t["start"] + 1 <= 5)


def _joined(ranges: Column, t: Column) -> Column:
    """Merged ranges with one more."""
    meets = lambda r: (r["start"] <= t["stop"] + 1) & (r["stop"] >= t["start"] - 1)
    met = F.filter(ranges, meets)
    low = F.least(t["start"], F.coalesce(F.array_min(F.transform(met, lambda r: r["start"])), t["start"]))
    high = F.greatest(t["stop"], F.coalesce(F.array_max(F.transform(met, lambda r: r["stop"])), t["stop"]))
    return F.array_sort(F.concat(F.filter(ranges, lambda r: ~meets(r)), F.array(F.struct(low.alias("start"), high.alias("stop")))))


def authorised(requests: DataFrame, ledger: DataFrame) -> DataFrame:
    """req, allowed, tier, rule, hint_offset, hint_limit, gained: the first rule that applies decides.

    ``requests``: req, session, path, op (edit or write), inside, exists, regular, enforced, fingerprint (now), targets
    (array of start and stop), blocks (array of text). ``gained`` has the ranges that the decision adds to what was seen.
    """
    d = requests.join(ledger.select("session", "path", "kind", F.col("fingerprint").alias("seen"), "complete", "ranges", "total", "hits", F.lit(True).alias("known")), ["session", "path"], "left")
    empty = F.array().cast(RANGES)
    d = d.withColumns({"ranges": F.coalesce("ranges", empty), "hits": F.coalesce("hits", F.array().cast("array<struct<line: bigint, text: string>>")), "targets": F.coalesce("targets", empty), "blocks": F.coalesce("blocks", F.array().cast("array<string>"))})
    pairs = F.arrays_zip("targets", "blocks")
    start = F.struct(F.lit(None).cast("string").alias("stop"), F.lit(None).cast("int").alias("at"), F.lit(True).alias("read"), F.col("ranges").alias("ranges"), empty.alias("gained"), F.lit(0).alias("i"))

    def step(a: Column, p: Column) -> Column:
        t, block = p["targets"], p["blocks"]
        bad = t.isNull() | (t["start"] < 1) | (t["stop"] < t["start"]) | (F.col("total").isNotNull() & (t["stop"] > F.col("total")))
        blank = block.isNull() | (trim_space(block) == "")
        seen = F.coalesce("complete", F.lit(False)) | _covers(a["ranges"], t) | _first_hit_close(F.col("hits"), t)
        near = ~seen & _adjacent(F.col("hits"), t)
        ok = seen | near
        stop = F.when(F.coalesce(bad, F.lit(True)), "malformed target").when(blank, "empty block").when(~ok & ~_substantive(block), "not covered")
        one = F.array(F.struct(t["start"].alias("start"), t["stop"].alias("stop")))
        on = a["stop"].isNull()
        return F.struct(
            F.when(on, stop).otherwise(a["stop"]).alias("stop"), F.when(on & stop.isNotNull(), a["i"]).otherwise(a["at"]).alias("at"), F.when(on & stop.isNull(), a["read"] & ok).otherwise(a["read"]).alias("read"),
            F.when(on & stop.isNull() & near, _joined(a["ranges"], t)).otherwise(a["ranges"]).alias("ranges"), F.when(on & stop.isNull() & near, F.concat(a["gained"], one)).otherwise(a["gained"]).alias("gained"), (a["i"] + 1).alias("i"),
        )

    aligned = (F.size("targets") > 0) & (F.size("targets") == F.size("blocks"))
    d = d.withColumn("aligned", aligned).withColumn("f", F.when(aligned & (F.col("op") == "edit") & F.col("known") & F.col("inside") & F.col("exists") & F.col("regular") & F.col("enforced") & F.col("fingerprint").eqNullSafe(F.col("seen")), F.aggregate(pairs, start, step)))
    read = F.col("kind") == "read"
    all_covered = F.col("complete") | ((F.size("targets") > 0) & F.forall("targets", lambda t: _covers(F.col("ranges"), t)))
    lone = (F.size("targets") == 1) & F.coalesce(_first_hit_close(F.col("hits"), F.element_at(F.concat("targets", F.array(F.struct(F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("stop")))), 1)), F.lit(False))
    rule = (
        F.when(F.coalesce("path", F.lit("")) == "", "deny: empty path").when(~F.col("inside"), "deny: outside").when(F.col("exists") & ~F.col("regular"), "deny: not a file").when(~F.col("exists") & (F.col("op") == "edit"), "deny: missing")
        .when(~F.col("enforced") | ~F.col("exists"), "allow").when(F.col("known").isNull(), "deny: uninspected").when(~F.col("fingerprint").eqNullSafe(F.col("seen")), "deny: stale")
        .when(F.col("op") == "write", F.when(read | F.col("complete"), "allow").otherwise("deny: read before write"))
        .when(F.col("aligned"), F.when(F.col("f.stop").isNotNull(), F.concat(F.lit("deny: "), F.col("f.stop"))).when(F.col("f.read"), "allow: seen").otherwise("allow: substantive"))
        .when(read & (all_covered | lone), "allow: seen").when(~read, "deny: search only")
        .when((F.size("blocks") > 0) & F.forall("blocks", _substantive), "allow: substantive").otherwise("deny: not covered")
    )
    d = d.withColumn("rule", rule)
    first = F.try_element_at("targets", F.lit(1))
    sound = (first["start"] >= 1) & (first["stop"] >= first["start"])
    stale_at = F.greatest(F.lit(1), first["start"] - 2)
    failing = F.try_element_at("targets", F.col("f.at") + 1)
    wanted = F.greatest(F.lit(15), failing["stop"] - failing["start"] + 5)
    room = F.when(F.col("total").isNotNull(), F.greatest(F.lit(1), F.col("total") - failing["start"] + 1)).otherwise(wanted)
    stale, uncovered = F.col("rule") == "deny: stale", (F.col("rule") == "deny: not covered") & F.col("f.at").isNotNull()
    return d.select(
        "req", F.startswith("rule", F.lit("allow")).alias("allowed"), F.when(F.col("rule") == "allow: seen", 1).when(F.col("rule") == "allow: substantive", 2).alias("tier"), "rule",
        F.when(stale & sound, stale_at).when(uncovered, failing["start"]).cast("long").alias("hint_offset"), F.when(stale & sound, F.least(F.lit(100), F.greatest(F.lit(15), first["stop"] - stale_at + 3))).when(uncovered, F.least(wanted, room)).cast("long").alias("hint_limit"),
        F.coalesce("f.gained", empty).alias("gained"),
    )

"""Queries of incremental maintenance, output windows, reading, sessions and matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.lines import line_hashes, lines_of
from ..functions.text import content_hash, format_count, is_diagnostic, is_safe_path, is_test_path, path_contains
from ..operators import maintenance, matching, output_window, sessions
from ..sources.tables import table
from .registry import query

_T0 = "t0 AS (SELECT o_orderkey AS path, o_totalprice AS hash FROM orders WHERE o_orderkey % 10 <> 1)"
_T1 = "t1 AS (SELECT o_orderkey AS path, CASE WHEN o_orderkey % 7 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS hash FROM orders WHERE o_orderkey % 10 <> 2)"


def _snapshots(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("path"), F.col("o_totalprice").alias("hash"))
    return o.where("path % 10 <> 1"), o.where("path % 10 <> 2").withColumn("hash", F.when(F.col("path") % 7 == 0, F.col("hash") + 1).otherwise(F.col("hash")))


@query("file_diff", f"""WITH {_T0}, {_T1} SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'deleted' WHEN a.hash IS NOT DISTINCT FROM b.hash THEN 'same' ELSE 'changed' END AS change FROM t0 a FULL JOIN t1 b ON a.path = b.path""")
def file_diff(spark, d):
    return maintenance.difference(*_snapshots(spark, d)).select("path", "change")


@query("deleted_keys", f"WITH {_T0}, {_T1} SELECT path FROM t0 EXCEPT SELECT path FROM t1")
def deleted_keys(spark, d):
    return maintenance.deleted(*_snapshots(spark, d))


@query("snapshot_equal", f"WITH {_T0}, {_T1} SELECT count(*) AS differing, count(*) = 0 AS equal FROM t0 a FULL JOIN t1 b ON a.path = b.path WHERE a.path IS NULL OR b.path IS NULL OR a.hash IS DISTINCT FROM b.hash")
def snapshot_equal(spark, d):
    return maintenance.same_snapshot(*_snapshots(spark, d))


@query("sync_plan", f"""WITH {_T0}, {_T1} SELECT coalesce(a.path, b.path) AS path, CASE WHEN b.path IS NULL THEN 'delete' WHEN a.path IS NULL OR a.hash IS DISTINCT FROM b.hash OR b.path % 11 = 0 THEN 'reindex' ELSE 'keep' END AS action FROM t0 a FULL JOIN t1 b ON a.path = b.path""")
def sync_plan(spark, d):
    old, new = _snapshots(spark, d)
    return maintenance.sync_plan(old, new, new.where("path % 11 = 0").select("path"))


_HASH = "substr(sha256(text), 1, 16)"


@query("content_hash", f"SELECT doc_id, {_HASH} AS hash FROM documents")
def content_hashes(spark, d):
    return table(spark, d, "documents").select("doc_id", content_hash("text").alias("hash"))


@query("vector_reuse", f"""WITH new AS (SELECT doc_id AS id, {_HASH} AS hash FROM documents), old AS (SELECT {_HASH} AS hash, doc_id AS seq, embedding AS v FROM documents JOIN embeddings ON doc_id = vec_id),
last AS (SELECT hash, arg_max(v, seq) AS v FROM old GROUP BY hash) SELECT id, last.hash IS NOT NULL AS reused, round(v[1]::DOUBLE, 6) AS first FROM new LEFT JOIN last USING (hash)""")
def vector_reuse(spark, d):
    """Documents take the vector of the latest document of equal content."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), content_hash("text").alias("hash"))
    old = docs.join(table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), "id").withColumn("seq", F.col("id"))
    return maintenance.reused_vectors(docs, old).select("id", F.col("vector").isNotNull().alias("reused"), F.round(F.element_at("vector", 1).cast("double"), 6).alias("first"))


@query("valid_vectors", f"SELECT vec_id AS id FROM embeddings JOIN documents ON vec_id = doc_id WHERE doc_id % 3 <> 0")
def valid_vectors(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), content_hash("text").alias("hash"))
    now = docs.withColumn("hash", F.when(F.col("id") % 3 == 0, F.lit("changed")).otherwise(F.col("hash")))
    return maintenance.still_valid(table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding"), docs, now).select("id")


@query("files_lacking_vectors", "SELECT DISTINCT source AS path FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def files_lacking_vectors(spark, d):
    chunks = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("path"))
    return maintenance.lacking_vector(chunks.select("path").distinct(), chunks, table(spark, d, "embeddings").select(F.col("vec_id").alias("id")))


@query("latest_generation", "SELECT user_id, ts, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_generation(spark, d):
    return maintenance.latest(table(spark, d, "events").select("user_id", "ts", "event_id", "event_type", "value"), ["user_id"], ["ts", "event_id"])


@query("greedy_budget", """WITH RECURSIVE s AS (SELECT source, doc_id, n_chars AS z, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents),
r AS (SELECT source, doc_id, i, z <= 30000 AS kept, CASE WHEN z <= 30000 THEN z ELSE 0 END AS used FROM s WHERE i = 1
UNION ALL SELECT s.source, s.doc_id, s.i, r.used + s.z <= 30000, r.used + CASE WHEN r.used + s.z <= 30000 THEN s.z ELSE 0 END FROM r JOIN s ON s.source = r.source AND s.i = r.i + 1)
SELECT source, doc_id, kept FROM r""")
def greedy_budget(spark, d):
    """Documents of each source that fit 30,000 characters, taken in order, oversized ones skipped."""
    docs = table(spark, d, "documents").select("source", "doc_id", "n_chars")
    return maintenance.admitted(docs, ["source"], "doc_id", "n_chars", 30_000).select("source", "doc_id", "kept")


@query("retention", """WITH n AS (SELECT user_id, event_id, ts, event_id % 97 + 1 AS size, row_number() OVER w AS nth, sum(event_id % 97 + 1) OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC ROWS UNBOUNDED PRECEDING) AS total FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts DESC, event_id DESC))
SELECT user_id, event_id FROM n WHERE nth <= 20 AND total <= 700""")
def retention(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", F.col("ts").alias("mtime"), (F.col("event_id") % 97 + 1).alias("size"), F.col("event_id").alias("name"))
    return maintenance.retained(e, ["user_id"], most_files=20, most_bytes=700).select("user_id", "event_id")


@query("integrity_checks", f"""WITH c AS (SELECT CASE WHEN i % 53 = 11 THEN 'x' ELSE path || ':' || start || '-' || stop END AS id, * FROM (SELECT doc_id AS i, CASE WHEN doc_id % 43 = 5 THEN '../' || source ELSE source END AS path, doc_id + 1 AS start, CASE WHEN doc_id % 47 = 9 THEN doc_id ELSE doc_id + 1 END AS stop,
  CASE WHEN doc_id % 41 = 3 THEN 'odd' WHEN doc_id % 2 = 0 THEN 'class' ELSE 'file' END AS kind, {_HASH} AS own, CASE WHEN doc_id % 50 = 7 THEN 'wrong' ELSE {_HASH} END AS hash FROM documents)),
f AS (SELECT DISTINCT source AS path FROM documents WHERE source <> 'src3' UNION ALL SELECT 'empty')
SELECT 'hash' AS rule, count(*) AS n FROM c WHERE hash <> own UNION ALL SELECT 'id_from_parts', count(*) FROM c WHERE id <> path || ':' || start || '-' || stop
UNION ALL SELECT 'kind', count(*) FROM c WHERE kind NOT IN ('class', 'file') UNION ALL SELECT 'path', count(*) FROM c WHERE regexp_matches(path, '(^|/)[.][.]?(/|$)') UNION ALL SELECT 'lines', count(*) FROM c WHERE start < 1 OR stop < start
UNION ALL SELECT 'hash_format', count(*) FROM c WHERE NOT regexp_full_match(hash, '[0-9a-f]{{16}}') UNION ALL SELECT 'most_chunks', (count(*) > 10000)::INT FROM c UNION ALL SELECT 'unique_id', count(*) FROM (SELECT id FROM c GROUP BY id HAVING count(*) > 1)
UNION ALL SELECT 'known_file', count(*) FROM c WHERE path NOT IN (SELECT path FROM f) UNION ALL SELECT 'file_has_chunk', count(*) FROM f WHERE path NOT IN (SELECT path FROM c)""")
def integrity_checks(spark, d):
    """Documents as chunks, some of which break each of the rules."""
    i, path, kind = F.col("doc_id"), F.when(F.col("doc_id") % 43 == 5, F.concat(F.lit("../"), "source")).otherwise(F.col("source")), F.when(F.col("doc_id") % 41 == 3, "odd").when(F.col("doc_id") % 2 == 0, "class").otherwise("file")
    start, stop = i + 1, F.when(i % 47 == 9, i).otherwise(i + 1)
    own = F.concat(path, F.lit(":"), start.cast("string"), F.lit("-"), stop.cast("string"))
    docs = table(spark, d, "documents")
    chunks = docs.select(F.when(i % 53 == 11, F.lit("x")).otherwise(own).alias("id"), path.alias("path"), start.alias("start"), stop.alias("stop"), F.lit("").alias("symbol"), kind.alias("kind"), F.col("text").alias("content"), F.when(i % 50 == 7, F.lit("wrong")).otherwise(content_hash("text")).alias("hash"))
    files = docs.select(F.col("source").alias("path")).distinct().where("path <> 'src3'").unionByName(spark.createDataFrame([("empty",)], "path string"))
    return maintenance.violations(chunks, files)


@query("index_status", "SELECT (SELECT count(DISTINCT source) FROM documents) AS files, (SELECT count(*) FROM documents WHERE n_chars > 20000) AS skipped, (SELECT count(*) FROM documents) AS chunks, (SELECT count(*) FROM embeddings) AS vectors")
def index_status(spark, d):
    docs = table(spark, d, "documents")
    return maintenance.index_status(docs.select("source").distinct(), docs, table(spark, d, "embeddings"), docs.where("n_chars > 20000"))


@query("bytes_by_file", "SELECT source AS path, count(*) AS nchunks, sum(strlen(text)) AS nbytes FROM documents GROUP BY source")
def bytes_by_file(spark, d):
    return maintenance.bytes_by_file(table(spark, d, "documents").select(F.col("source").alias("path"), F.col("text").alias("content")))


# --- windows and reading ---------------------------------------------------------------------------------------------


@query("head_tail_lines", """WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), x AS (SELECT doc_id, len(ls) AS total, unnest(range(1, len(ls) + 1)) AS n, unnest(ls) AS line FROM l)
SELECT doc_id, n, CASE WHEN length(line) > 100 THEN line[1:40] || '... <line ' || n || ' truncated: ' || format('{:,}', length(line) - 40) || ' chars omitted>' ELSE line END AS line FROM x WHERE total <= 6 OR n <= 3 OR n > total - 3""")
def head_tail_lines(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.regexp_replace("text", "\r", "").alias("text"), F.lit("cat x").alias("command"), F.lit(None).cast("boolean").alias("is_error"))
    return output_window.shown_lines(docs, ["doc_id"], max_lines=6, max_width=100).select("doc_id", F.col("n").cast("long").alias("n"), "line")


@query("diag_window", """WITH o AS (SELECT page_id, string_split(replace(html, '><', '>' || chr(10) || '<'), chr(10)) AS ls FROM pages),
x AS (SELECT page_id, len(ls) AS total, CASE WHEN len(ls) > 10 THEN nullif(list_position(list_transform(ls, lambda s: regexp_matches(s, '\\b(?:TypeError|SyntaxError|ReferenceError|Error):\\s') OR regexp_matches(s, '^\\s*(?:FAIL|✕|×)\\s+\\S+') OR regexp_matches(s, '\\bAssertionError:\\s') OR regexp_matches(s, '\\berror\\[E\\d+\\]:\\s') OR regexp_matches(s, '-->\\s+\\S+:\\d+:\\d+')), true), 0) - 1 END AS d FROM o),
w AS (SELECT *, least(total - 2, greatest(2, d - 3) + 6) AS stop0, greatest(2, d - 3) AS start0 FROM x)
SELECT page_id, total::BIGINT AS total, d::BIGINT AS first_diag, (CASE WHEN total > 10 THEN 2 ELSE total END)::BIGINT AS head, (CASE WHEN total > 10 THEN 2 ELSE 0 END)::BIGINT AS tail,
  CASE WHEN total <= 10 THEN NULL WHEN d IS NULL THEN greatest(2, total - 8) WHEN stop0 = total - 2 THEN greatest(2, stop0 - 6) ELSE start0 END::BIGINT AS win_start, CASE WHEN total <= 10 THEN NULL WHEN d IS NULL THEN total - 2 ELSE stop0 END::BIGINT AS win_end FROM w""")
def diag_window(spark, d):
    pages = table(spark, d, "pages").select("page_id", F.replace("html", F.lit("><"), F.lit(">\n<")).alias("text"), F.lit("run it").alias("command"), F.lit(True).alias("is_error"))
    p = output_window.window_plan(pages, max_lines=10)
    return p.select("page_id", *(F.col(c).cast("long").alias(c) for c in ("total", "first_diag", "head", "tail", "win_start", "win_end")))


@query("diagnostic_lines", """WITH l AS (SELECT page_id, CASE WHEN i % 5 = 0 THEN '  FAIL ' || x WHEN i % 7 = 0 THEN 'error[E' || i || ']: ' || x WHEN i % 11 = 0 THEN ' --> a.rs:' || i || ':2' ELSE x END AS x FROM (SELECT page_id, unnest(ls) AS x, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT page_id, string_split(replace(html, '><', '>' || chr(10) || '<'), chr(10)) AS ls FROM pages)))
SELECT page_id, count(*) AS n FROM l WHERE regexp_matches(x, '-->\\s+\\S+:\\d+:\\d+') OR regexp_matches(x, '^\\s*(?:FAIL|✕|×)\\s+\\S+') OR regexp_matches(x, '^\\s*error\\[E\\d+\\]:\\s') GROUP BY page_id""")
def diagnostic_lines(spark, d):
    """Pages' lines, some of them dressed as a tool's complaints."""
    i = (F.col("at") + 1).cast("string")
    lines = table(spark, d, "pages").select("page_id", F.posexplode(lines_of(F.replace("html", F.lit("><"), F.lit(">\n<")))).alias("at", "x"))
    nth = F.col("at") + 1
    said = F.when(nth % 5 == 0, F.concat(F.lit("  FAIL "), "x")).when(nth % 7 == 0, F.concat(F.lit("error[E"), i, F.lit("]: "), "x")).when(nth % 11 == 0, F.concat(F.lit(" --> a.rs:"), i, F.lit(":2"))).otherwise(F.col("x"))
    return lines.where(is_diagnostic(said, False)).groupBy("page_id").agg(F.count("*").alias("n"))


@query("clamp_outputs")
def clamp_outputs(spark, d):
    """Every document as a command's output, within 2,000 bytes."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", F.lit("pytest").alias("command"), (F.col("doc_id") % 2 == 0).alias("is_error"))
    return output_window.clamp_outputs(docs, max_lines=12, max_width=200, max_bytes=2000)


@query("line_window", """WITH l AS (SELECT doc_id, string_split(text, chr(10))[3:7] AS ls FROM documents), x AS (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS i, unnest(ls) AS line FROM l),
s AS (SELECT *, sum(strlen(line)) OVER (PARTITION BY doc_id ORDER BY i) + i - 1 AS used FROM x) SELECT doc_id, i + 2 AS n, line FROM s WHERE used <= 1500""")
def line_window(spark, d):
    return output_window.line_window(table(spark, d, "documents").select("doc_id", F.col("text").alias("content")), ["doc_id"], offset=3, limit=5, most_bytes=1500)


@query("batch_read_budget", """WITH e AS (SELECT source, doc_id, array_to_string(string_split(text, chr(10))[1:5], chr(10)) AS x, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS nth FROM documents),
s AS (SELECT source, doc_id, strlen(x) AS nbytes, sum(strlen(x)) OVER (PARTITION BY source ORDER BY doc_id) AS total FROM e WHERE nth <= 20) SELECT source, doc_id, nbytes::BIGINT AS nbytes, total::BIGINT AS total FROM s WHERE total - nbytes < 9000""")
def batch_read_budget(spark, d):
    docs = table(spark, d, "documents").select("source", "doc_id", F.col("text").alias("content"))
    return output_window.batch_read(docs, ["source"], "doc_id", lines=5, most_bytes=9000).select("source", "doc_id", "nbytes", "total")


# --- sessions --------------------------------------------------------------------------------------------------------
def _log(spark, d):
    """Conversations as a log: an assistant's turn calls a tool and has a usage, a user's turn is a tool's result."""
    t = table(spark, d, "conversations")
    tool = F.when(F.col("turn") % 3 == 0, F.lit("code_search")).when(F.col("turn") % 3 == 1, F.lit("read"))
    text = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("[code_search auto]\nnotes.md:1: "), F.coalesce("text", F.lit("")))).otherwise(F.coalesce("text", F.lit("")))
    usage = F.struct(F.length(F.coalesce("text", F.lit(""))).cast("double").alias("input"), F.lit(2.0).alias("output"), F.struct(F.lit(0.5).alias("total")).alias("cost"))
    result = F.col("role") == "user"
    block = F.struct(F.when(result, "text").otherwise("toolCall").alias("type"), F.when(result, text).alias("text"), F.when(~result, tool).alias("name"))
    message = F.struct(F.when(result, "toolResult").otherwise(F.col("role")).alias("role"), F.when(result, tool).alias("toolName"), F.array(block).alias("content"), F.when(~result, usage).alias("usage"))
    return t.select("conv_id", F.to_json(F.struct(F.lit("message").alias("type"), message.alias("message"))).alias("value"))


_CALLS = "coalesce(CASE turn % 3 WHEN 0 THEN 'code_search' WHEN 1 THEN 'read' END, 'unknown')"
_TEXT = "CASE WHEN turn % 3 = 0 THEN '[code_search auto]' || chr(10) || 'notes.md:1: ' || coalesce(text, '') ELSE coalesce(text, '') END"


@query("session_metrics", f"""SELECT conv_id, 'call' AS what, {_CALLS} AS name, count(*)::BIGINT AS n FROM conversations WHERE role IS DISTINCT FROM 'user' GROUP BY 1, 3
UNION ALL SELECT conv_id, 'chars', {_CALLS}, sum(length({_TEXT}))::BIGINT FROM conversations WHERE role = 'user' GROUP BY 1, 3
UNION ALL SELECT conv_id, 'chars', NULL, sum(length({_TEXT}))::BIGINT FROM conversations WHERE role = 'user' GROUP BY 1
UNION ALL SELECT conv_id, 'prose', '[code_search auto]', sum(len(list_filter(string_split({_TEXT}, chr(10)), lambda x: regexp_matches(x, '(?:\\.md|\\.mdx|\\.txt|\\.rst):\\d'))))::BIGINT FROM conversations WHERE role = 'user' AND turn % 3 = 0 GROUP BY 1""")
def session_metrics(spark, d):
    found = sessions.blocks(sessions.entries(_log(spark, d)), ["conv_id"])
    rows = lambda df, what, name, n: df.select("conv_id", F.lit(what).alias("what"), F.col(name).alias("name"), F.col(n).cast("long").alias("n"))
    prose = sessions.search_modes(found, ["conv_id"]).groupBy("conv_id", "header").agg(F.sum("prose_lines").alias("n"))
    return rows(sessions.tool_calls(found, ["conv_id"]), "call", "name", "calls").unionByName(rows(sessions.tool_output(found, ["conv_id"]), "chars", "tool", "chars")).unionByName(rows(prose, "prose", "header", "n"))


@query("usage_rollup", "SELECT conv_id, sum(length(coalesce(text, '')))::DOUBLE AS tokens_in, count(*) * 2.0::DOUBLE AS tokens_out, count(*) * 0.5::DOUBLE AS cost FROM conversations WHERE role = 'assistant' GROUP BY conv_id")
def usage_rollup(spark, d):
    return sessions.usage_totals(sessions.entries(_log(spark, d)), ["conv_id"])


@query("role_totals", "SELECT conv_id, role, count(*) AS turns, sum(length(text)) AS chars FROM conversations GROUP BY conv_id, role")
def role_totals(spark, d):
    return sessions.role_totals(table(spark, d, "conversations"), ["conv_id"])


@query("measure_session")
def measure_session(spark, d):
    return sessions.measured(sessions.entries(_log(spark, d)), ["conv_id"])


@query("session_repair")
def session_repair(spark, d):
    """Logs without costs, repaired: one file a conversation."""
    log = _log(spark, d).select("conv_id", F.regexp_replace("value", '"cost":\\{"total":0.5\\}', '"cost":{}').alias("value"))
    files = log.groupBy(F.col("conv_id").cast("string").alias("path")).agg(F.array_join(F.array_sort(F.collect_list("value")), "\n").alias("content"))
    return sessions.repaired(files)


@query("debounce_sessions", """WITH o AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w < 3600000000 THEN 0 ELSE 1 END AS o FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
b AS (SELECT user_id, ts, sum(o) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS b FROM o) SELECT user_id, min(ts) AS first, max(ts) AS last, count(*) AS n FROM b GROUP BY user_id, b""")
def debounce_sessions(spark, d):
    return sessions.debounced(table(spark, d, "events"), ["user_id"], gap_ms=3_600_000)


@query("debounce_capped", """WITH RECURSIVE o AS (SELECT user_id, ts, row_number() OVER w AS i, epoch_us(ts) - lag(epoch_us(ts)) OVER w < 3600000000 AS near FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT user_id, ts, i, ts AS first FROM o WHERE i = 1 UNION ALL SELECT o.user_id, o.ts, o.i, CASE WHEN o.near AND epoch_us(o.ts) - epoch_us(r.first) < 7200000000 THEN r.first ELSE o.ts END FROM r JOIN o ON o.user_id = r.user_id AND o.i = r.i + 1),
b AS (SELECT user_id, first, min(i) AS i0, max(ts) AS last, count(*) AS n FROM r GROUP BY user_id, first) SELECT user_id, first, last, n FROM b""")
def debounce_capped(spark, d):
    return sessions.debounced(table(spark, d, "events"), ["user_id"], gap_ms=3_600_000, cap_ms=7_200_000)


# --- lines, paths, matching ------------------------------------------------------------------------------------------
@query("line_hash", """WITH d AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: rtrim(replace(x, chr(13), ''), ' ' || chr(9) || chr(11) || chr(12))) AS ls FROM documents),
l AS (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS i, ls FROM d),
u AS (SELECT doc_id, i - 1 AS line, list_transform(string_split(coalesce(ls[i - 1], '') || chr(1) || ls[i] || chr(1) || coalesce(ls[i + 1], ''), ''), lambda c: CASE WHEN c = chr(1) THEN 0 ELSE unicode(c) END) AS cs FROM l),
b AS (SELECT doc_id, line, list_prepend(197, flatten(list_transform(cs, lambda c: CASE WHEN c > 65535 THEN [((c - 65536) >> 10) & 255, c & 255] ELSE [c & 255] END))) AS bs FROM u)
SELECT doc_id, line::INT AS line, printf('%02X', list_reduce(bs, lambda h, c: (xor(h, c) * 147) & 255)) AS hash FROM b""")
def line_hash(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(line_hashes("text")).alias("line", "hash"))


@query("exact_match_count", """WITH q AS (SELECT 'tion the' AS s) SELECT doc_id AS id, list_sum(list_transform(range(1, length(text) - length(s) + 2), lambda i: (text[i:i + length(s) - 1] = s)::INT))::BIGINT AS n_exact FROM documents, q WHERE length(text) >= length(s)
UNION ALL SELECT doc_id, 0 FROM documents WHERE length(text) < 8""")
def exact_match_count(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.regexp_replace("text", "\r\n", "\n").alias("content"))
    n = F.size(matching.occurrences(F.col("content"), F.lit("tion the")))
    return docs.select("id", n.cast("long").alias("n_exact"))


@query("normalized_match", """WITH d AS (SELECT doc_id AS id, list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(11) || chr(12) || chr(13))) AS ls FROM documents WHERE text IS NOT NULL),
q AS (SELECT id AS block, ls AS w, len(ls) AS k FROM d WHERE id % 20 = 0 AND array_to_string(ls, '') <> ''),
p AS (SELECT id, k, unnest(range(1, len(ls) - k + 2)) AS i, ls FROM d, (SELECT DISTINCT k FROM q) WHERE len(ls) >= k),
m AS (SELECT id, count(*) AS n FROM (SELECT id, k, md5(array_to_string(ls[i:i + k - 1], chr(10))) AS h FROM p) JOIN (SELECT k, md5(array_to_string(w, chr(10))) AS h FROM q) USING (k, h) GROUP BY id)
SELECT doc_id AS id, coalesce(n, 0)::BIGINT AS n_normal FROM documents LEFT JOIN m ON doc_id = id""")
def normalized_match(spark, d):
    """Every twentieth document as a block of lines, looked for in all documents, white space at line ends aside."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    blocks = docs.where("id % 20 = 0").select(F.col("id").alias("block"), F.col("content").alias("search"))
    found = matching.blocks_in(docs, blocks).groupBy("id").agg(F.count("*").alias("n_normal"))
    return docs.select("id").join(found, "id", "left").select("id", F.coalesce("n_normal", F.lit(0)).cast("long").alias("n_normal"))


@query("fuzzy_match")
def fuzzy_match(spark, d):
    """A garbled second line of every document of several lines, looked for in it."""
    docs = table(spark, d, "documents").where(F.size(lines_of("text")) > 1)
    second = F.coalesce(F.try_element_at(lines_of("text"), F.lit(2)), F.lit(""))
    r = docs.select(F.col("doc_id").alias("id"), F.col("text").alias("content"), F.concat(F.lit("q"), second).alias("search"), F.lit("new").alias("replace"), F.lit(None).cast("int").alias("line_hint"))
    return matching.located(r).select("id", "strategy", "error", "first", "last", F.round("score", 6).alias("score"))


@query("url_filter", "SELECT page_id, contains(lower(replace(url, chr(92), '/')), 'example.com/fr') AS hit FROM pages")
def url_filter(spark, d):
    return table(spark, d, "pages").select("page_id", path_contains("url", "Example.com\\FR").alias("hit"))


@query("path_predicates", """WITH p AS (SELECT page_id, regexp_replace(url, '^https?://', '') AS p FROM pages)
SELECT page_id, NOT regexp_matches(p, '[\\x00:\\\\]') AND len(list_filter(string_split(p, '/'), lambda x: x IN ('', '.', '..'))) = 0 AS safe, contains(lower(p), 'test_') OR contains(lower(p), '/tests/') OR contains(lower(p), '/test/') OR contains(lower(p), '/__tests__/') OR contains(lower(p), '/spec/') OR contains(lower(p), '/specs/') OR contains(lower(p), '_test.') OR contains(lower(p), '.test.') OR contains(lower(p), '.spec.') OR starts_with(lower(p), 'test/') OR starts_with(lower(p), 'tests/') OR starts_with(lower(p), 'spec/') AS test FROM p""")
def path_predicates(spark, d):
    p = table(spark, d, "pages").select("page_id", F.regexp_replace("url", "^https?://", "").alias("p"))
    return p.select("page_id", is_safe_path("p").alias("safe"), is_test_path("p").alias("test"))


@query("token_format", """SELECT o_orderkey, CASE WHEN n < 1000 THEN n::VARCHAR WHEN n < 10000 THEN printf('%.1fk', round(n / 1000.0, 1)) WHEN n < 1000000 THEN floor(n / 1000.0 + 0.5)::BIGINT || 'k' WHEN n < 10000000 THEN printf('%.1fM', round(n / 1000000.0, 1)) ELSE floor(n / 1000000.0 + 0.5)::BIGINT || 'M' END AS shown FROM (SELECT o_orderkey, (o_totalprice * (o_orderkey % 40 + 1))::BIGINT // 10 AS n FROM orders)""")
def token_format(spark, d):
    n = F.floor(F.rint(F.col("o_totalprice") * (F.col("o_orderkey") % 40 + 1)) / 10).cast("long")
    return table(spark, d, "orders").select("o_orderkey", format_count(n).alias("shown"))

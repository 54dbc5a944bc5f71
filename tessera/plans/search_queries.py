"""Queries of the search plane over documents and embeddings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.lines import lines_of
from ..functions.text import compact_signature, path_contains, query_terms, query_tokens
from ..functions.vectors import layer_norm_slice
from ..operators import bm25, fusion, shaping, vector
from ..sources.tables import chunks, staged, table
from .registry import query

QUERY = "the erant of ouher and thonon ering edlyBle"
PATTERN = "SRC1"

TOK = r"""tok AS (SELECT doc_id AS id, source, list_filter(flatten(list_transform(regexp_extract_all(coalesce(text, ''), '[a-zA-Z0-9_]+'), lambda r: list_concat([lower(r)],
  CASE WHEN contains(r, '_') THEN list_transform(string_split(r, '_'), lambda p: lower(p)) ELSE []::VARCHAR[] END,
  CASE WHEN regexp_matches(r, '[a-z][A-Z]') THEN list_transform(string_split(regexp_replace(r, '([a-z])([A-Z])', '\1 \2', 'g'), ' '), lambda p: lower(p)) ELSE []::VARCHAR[] END))), lambda t: length(t) >= 2) AS toks FROM documents),
term AS (SELECT id, unnest(toks) AS term FROM tok),
post AS (SELECT term, id, count(*) AS tf FROM term GROUP BY term, id),
len AS (SELECT id, source, len(toks) AS dl FROM tok),
freq AS (SELECT term, count(*) AS df FROM post GROUP BY term),
stat AS (SELECT count(*) AS ndocs, avg(dl) AS avgdl FROM len)"""


def _lexical(text: str, limit: int, where: str = "true") -> str:
    """CTEs up to ``lex``: id, score, matches, bm25_rank."""
    asked = ", ".join(f"('{t}', {i})" for i, t in enumerate(query_terms(text)))
    return f"""{TOK}, asked(term, pos) AS (VALUES {asked}),
part AS (SELECT id, pos, term, ln(1 + (ndocs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * (CASE WHEN dl = 0 THEN avgdl ELSE dl END / CASE WHEN avgdl = 0 THEN 1 ELSE avgdl END))) AS s
  FROM post JOIN asked USING (term) JOIN freq USING (term) JOIN len USING (id), stat WHERE {where}),
lex AS (SELECT *, row_number() OVER (ORDER BY round(score, 6) DESC, id) AS bm25_rank FROM (SELECT id, list_sum(list(s ORDER BY pos)) AS score, list(term ORDER BY pos) AS matches FROM part GROUP BY id) QUALIFY bm25_rank <= {limit})"""


def _semantic(threshold: float, limit: int = 100) -> str:
    dot = "list_sum(list_transform(range(1, len(e.embedding) + 1), lambda i: e.embedding[i]::DOUBLE * q.embedding[i]::DOUBLE))"
    return f"sem AS (SELECT id, sim, row_number() OVER (ORDER BY round(sim, 6) DESC, id) AS vector_rank FROM (SELECT e.vec_id AS id, {dot} AS sim FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q) WHERE round(sim, 9) >= {threshold} QUALIFY vector_rank <= {limit})"


def _fused(k: int) -> str:
    return f"""fused AS (SELECT coalesce(l.id, s.id) AS id, coalesce(1.0 / ({k} + bm25_rank), 0) + coalesce(1.0 / ({k} + vector_rank), 0) AS rrf, coalesce(score, 0) AS bm25_score, coalesce(sim, 0) AS sim, bm25_rank, vector_rank,
  CASE WHEN bm25_rank IS NOT NULL AND vector_rank IS NOT NULL THEN 'hybrid' WHEN vector_rank IS NOT NULL THEN 'semantic' ELSE 'lexical' END AS signal FROM lex l FULL JOIN sem s ON l.id = s.id)"""


def _toks(spark, d):
    """Tokens of all documents, with what filters need; made once and staged."""
    return staged(bm25.tokenised(chunks(spark, d), "content", "id", "path"), "tokens")


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


def _probe(spark, d):
    return table(spark, d, "embeddings").where("vec_id = 0").select(F.col("embedding").alias("q"))


@query("token_counts", f"WITH {TOK} SELECT term, id, tf FROM post")
def token_counts(spark, d):
    return bm25.postings(bm25.tokenised(chunks(spark, d))).select("term", "id", "tf")


@query("doc_lengths", f"WITH {TOK} SELECT id, dl FROM len")
def doc_lengths(spark, d):
    return bm25.doc_lengths(bm25.tokenised(chunks(spark, d)))


@query("doc_freq", f"WITH {TOK} SELECT term, df FROM freq")
def doc_freq(spark, d):
    return bm25.doc_frequencies(bm25.postings(bm25.tokenised(chunks(spark, d))))


@query("corpus_stats", f"WITH {TOK} SELECT ndocs, round(avgdl, 6) AS avgdl FROM stat")
def corpus_stats(spark, d):
    return bm25.corpus_stats(bm25.doc_lengths(bm25.tokenised(chunks(spark, d)))).withColumn("avgdl", F.round("avgdl", 6))


def _report(found):
    return found.select("id", F.round("score", 6).alias("score"), F.array_join("matches", ",").alias("matches"), F.col("bm25_rank").cast("long").alias("bm25_rank"))


_REPORT = "SELECT id, round(score, 6) AS score, array_to_string(matches, ',') AS matches, bm25_rank FROM lex"


@query("bm25_topk", f"WITH {_lexical(QUERY, 100)} {_REPORT}")
def bm25_topk(spark, d):
    return _report(bm25.search(bm25.tokenised(chunks(spark, d)), QUERY, 100))


@query("bm25_filtered", f"WITH {_lexical(QUERY, 50, "contains(lower(source), 'src1')")} {_REPORT}")
def bm25_filtered(spark, d):
    """The filter leaves counts and lengths as they are over all documents."""
    return _report(bm25.search(_toks(spark, d), QUERY, 50, keep=path_contains("path", PATTERN)))


@query("bm25_from_index", f"WITH {_lexical(QUERY, 50)} {_REPORT}")
def bm25_from_index(spark, d):
    index = bm25.build_index(_toks(spark, d).select("id", "toks"))
    return _report(bm25.search_index(index, QUERY, 50))


@query("bm25_matches", f"WITH {_lexical(QUERY, 1_000_000_000)} SELECT term, count(*) AS hits, count(*) FILTER (bm25_rank <= 10) AS in_top10 FROM (SELECT bm25_rank, unnest(matches) AS term FROM lex) GROUP BY term")
def bm25_matches(spark, d):
    """Which terms the hits matched on, over all hits and the ten best."""
    hits = staged(bm25.scored(_toks(spark, d), QUERY), "hits")
    every = hits.select(F.explode("matches").alias("term")).groupBy("term").agg(F.count("*").alias("hits"))
    best = bm25.ranked(hits, 10).select(F.explode("matches").alias("term")).groupBy("term").agg(F.count("*").alias("in_top10"))
    return every.join(best, "term", "left").select("term", "hits", F.coalesce("in_top10", F.lit(0)).alias("in_top10"))


@query("stopword_query", f"WITH {_lexical('the of', 20)} {_REPORT}")
def stopword_query(spark, d):
    """Nothing but stop words: they are kept."""
    return _report(bm25.search(bm25.tokenised(chunks(spark, d)), "the of", 20))


@query("bm25_incremental", f"WITH {TOK.replace('FROM documents)', "FROM (SELECT doc_id, source, CASE WHEN doc_id % 5 = 1 THEN text || ' freshToken_x' ELSE text END AS text FROM documents WHERE doc_id % 7 <> 3))")} SELECT term, df FROM freq")
def bm25_incremental(spark, d):
    """Term counts kept up to date under deletes and rewrites equal those of a rebuild."""
    docs = chunks(spark, d)
    index = bm25.build_index(_toks(spark, d).select("id", "toks"))
    changed = docs.where("id % 5 = 1 AND id % 7 <> 3").withColumn("content", F.concat("content", F.lit(" freshToken_x")))
    return bm25.updated(index, docs.where("id % 7 = 3"), staged(bm25.tokenised(changed), "changed")).frequencies


@query("vector_topk", f"WITH {_semantic(0.2)} SELECT id, round(sim, 6) AS sim, vector_rank FROM sem")
def vector_topk(spark, d):
    return vector.search(_vectors(spark, d), _probe(spark, d), 0.2).select("id", F.round("sim", 6).alias("sim"), F.col("vector_rank").cast("long").alias("vector_rank"))


@query("vector_abstain", f"WITH {_semantic(0.55)} SELECT id, round(sim, 6) AS sim, vector_rank FROM sem")
def vector_abstain(spark, d):
    """Under the usual floor little but the probe itself is left."""
    return vector.search(_vectors(spark, d), _probe(spark, d)).select("id", F.round("sim", 6).alias("sim"), F.col("vector_rank").cast("long").alias("vector_rank"))


@query("vector_ready", "SELECT n AS nvectors, n AS usable, m AS nchunks, n = m AND n > 0 AS ready FROM (SELECT count(*) AS n FROM embeddings WHERE len(embedding) = 64), (SELECT count(*) AS m FROM documents)")
def vector_ready(spark, d):
    return vector.is_ready(_vectors(spark, d), chunks(spark, d).agg(F.count("*").alias("n")), 64)


def _shown(found):
    return found.select("id", F.round("rrf", 9).alias("rrf"), F.round("bm25_score", 6).alias("bm25_score"), F.round("sim", 6).alias("sim"), F.col("bm25_rank").cast("long").alias("bm25_rank"), F.col("vector_rank").cast("long").alias("vector_rank"), "signal")


_SHOWN = "SELECT id, round(rrf, 9) AS rrf, round(bm25_score, 6) AS bm25_score, round(sim, 6) AS sim, bm25_rank, vector_rank, signal FROM fused"


@query("rrf_fusion", f"WITH {_lexical(QUERY, 100)}, {_semantic(0.2)}, {_fused(60)} {_SHOWN} ORDER BY fused.rrf DESC, bm25_rank NULLS LAST, vector_rank NULLS LAST LIMIT 15")
def rrf_fusion(spark, d):
    found = fusion.hybrid_search(bm25.tokenised(chunks(spark, d)), QUERY, _vectors(spark, d), _probe(spark, d), limit=fusion.result_limit(99), threshold=0.2)
    return _shown(found)


@query("rrf_filtered", f"WITH {_lexical(QUERY, 100, "contains(lower(source), 'src1')")}, {_semantic(0.1).replace('FROM embeddings e,', "FROM (SELECT * FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents WHERE contains(lower(source), 'src1'))) e,")}, {_fused(60)} {_SHOWN}")
def rrf_filtered(spark, d):
    """One path filter on both legs."""
    return _shown(fusion.hybrid_search(_toks(spark, d), QUERY, _vectors(spark, d), _probe(spark, d), keep=path_contains("path", PATTERN), limit=1000, threshold=0.1))


@query("rrf_k_sweep", f"WITH {_lexical(QUERY, 100)}, {_semantic(0.2)} " + " UNION ALL ".join(f"SELECT {k} AS k, id, round(rrf, 9) AS rrf, signal FROM (WITH {_fused(k)} SELECT * FROM fused)" for k in (1, 60, 200)))
def rrf_k_sweep(spark, d):
    lexical = staged(bm25.search(bm25.tokenised(chunks(spark, d)), QUERY, 100), "lexical")
    semantic = staged(vector.search(_vectors(spark, d), _probe(spark, d), 0.2), "semantic")
    out = [fusion.fuse(lexical, semantic, k).select(F.lit(fusion.rrf_constant(k)).alias("k"), "id", F.round("rrf", 9).alias("rrf"), "signal") for k in (0.5, 60.9, 1000)]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("rrf_signal_counts", f"WITH {_lexical(QUERY, 100)}, {_semantic(0.2)}, {_fused(60)} SELECT signal, count(*) AS n, round(sum(rrf), 6) AS rrf FROM fused GROUP BY signal")
def rrf_signal_counts(spark, d):
    both = fusion.fuse(bm25.search(bm25.tokenised(chunks(spark, d)), QUERY, 100), vector.search(_vectors(spark, d), _probe(spark, d), 0.2))
    return both.groupBy("signal").agg(F.count("*").alias("n"), F.round(F.sum("rrf"), 6).alias("rrf"))


@query("search_off", f"WITH {_lexical(QUERY, 0)} {_REPORT}")
def search_off(spark, d):
    return _report(fusion.hybrid_search(bm25.tokenised(chunks(spark, d)), QUERY, profile="off").withColumnRenamed("bm25_score", "score"))


@query("layer_norm_slice", """WITH v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
m AS (SELECT id, e, list_avg(e) AS mu, len(e) AS n FROM v), s AS (SELECT id, e, mu, list_sum(list_transform(e, lambda x: (x - mu) * (x - mu))) / n AS var FROM m),
z AS (SELECT id, list_transform(e[1:16], lambda x: (x - mu) / sqrt(var + 1e-5)) AS z FROM s)
SELECT id, round(z[1] / sqrt(list_sum(list_transform(z, lambda x: x * x))), 6) AS first, round(z[16] / sqrt(list_sum(list_transform(z, lambda x: x * x))), 6) AS last, len(z)::BIGINT AS width FROM z""")
def layer_norm(spark, d):
    out = _vectors(spark, d).select("id", layer_norm_slice(F.col("vector"), 16).alias("z"))
    return out.select("id", F.round(F.element_at("z", 1), 6).alias("first"), F.round(F.element_at("z", 16), 6).alias("last"), F.size("z").cast("long").alias("width"))


# --- shaping ---------------------------------------------------------------------------------------------------------
def _hits(spark, d, found, width: int | None = None):
    """Hits with their documents, written down: the few that are shown are looked at several times. ``width`` cuts lines."""
    docs = chunks(spark, d).withColumnRenamed("path", "p")
    if width:
        docs = docs.withColumn("content", F.array_join(F.transform(lines_of("content"), lambda x: F.substring(x, 1, width)), "\n"))
    n = F.size(lines_of("content"))
    return staged(docs.join(F.broadcast(found), "id").select("id", F.col("bm25_rank").alias("rank"), F.concat("p", F.lit("/"), F.col("id").cast("string"), F.lit(".md")).alias("path"), "kind", F.col("id").cast("string").alias("symbol"), F.element_at(lines_of("content"), 1).alias("signature"), F.lit("// crumb").alias("breadcrumb"), F.lit(1).alias("start_line"), n.alias("end_line"), "content", F.lit("lexical").alias("signal"), "matches"), "hits")


def _count(line: str) -> str:
    return " + ".join(f"contains(lower({line}), '{t}')::INT" for t in dict.fromkeys(query_tokens(QUERY)))


_SIGNATURE = "CASE WHEN length(sig) > 220 THEN sig[1:217] || '...' ELSE sig END"
_LINES = "string_split(text, chr(10))"
_PREVIEWS = f"""hit AS (SELECT doc_id AS id, source || '/' || doc_id || '.md' AS path, lang AS kind, {_LINES} AS ls FROM documents),
scored AS (SELECT *, len(ls) AS n, list_transform(ls, lambda x: {_count('x')}) AS sc, trim(regexp_replace(ls[1], '\\s+', ' ', 'g')) AS sig FROM hit),
best AS (SELECT *, list_position(sc, list_max(sc)) - 1 AS best FROM scored),
win AS (SELECT *, CASE WHEN greatest(0, best - 2) + 12 > n THEN greatest(0, n - 12) ELSE greatest(0, best - 2) END AS a FROM best),
body AS (SELECT *, least(n, a + 12) AS z, CASE WHEN a > 0 THEN '... lines 1-' || a || ' omitted ...' || chr(10) ELSE '' END || array_to_string(ls[a + 1:least(n, a + 12)], chr(10)) || CASE WHEN least(n, a + 12) < n THEN chr(10) || '... lines ' || (1 + least(n, a + 12)) || '-' || n || ' omitted ...' ELSE '' END AS ex FROM win),
preview AS (SELECT *, length(ex) > 1400 AS clipped, CASE WHEN length(ex) > 1400 THEN ex[1:1400] || chr(10) || '... preview clipped ...' ELSE ex END AS shown FROM body)"""
_HEAD = f"path || ':1-' || n || ' [' || kind || '] ' || id || CASE WHEN sig <> '' AND sig <> id::VARCHAR THEN ' — ' || {_SIGNATURE} ELSE '' END || ' [lexical]; matches: ' || array_to_string(matches[1:5], ', ')"


@query("preview_window", f"WITH {_PREVIEWS} SELECT id, best::BIGINT AS best, a::BIGINT AS first, z::BIGINT AS last, clipped, length(shown)::BIGINT AS chars, md5(shown) AS body FROM preview")
def preview_window(spark, d):
    """The excerpt of every document around its best line."""
    docs = chunks(spark, d).select("id", "path", "kind", F.col("id").cast("string").alias("symbol"), F.lit("").alias("signature"), F.lit(1).alias("start_line"), F.size(lines_of("content")).alias("end_line"), "content", F.lit("").alias("signal"), F.array().cast("array<string>").alias("matches"))
    p = shaping.previews(docs, QUERY)
    return p.select("id", *(F.col(c).cast("long").alias(c) for c in ("best", "first", "last")), "clipped", F.length("body").cast("long").alias("chars"), F.md5("body").alias("body"))


def _mixed(limit: int) -> str:
    return f"""WITH {_lexical(QUERY, limit)}, {_PREVIEWS},
entry AS (SELECT bm25_rank AS r, id, a, z, clipped, CASE WHEN bm25_rank <= 3 THEN {_HEAD} || chr(10) || '```md' || chr(10) || shown || chr(10) || '```' ELSE {_HEAD} END AS t FROM preview JOIN lex USING (id)),
run AS (SELECT *, sum(length(t) + CASE WHEN r > 1 THEN 2 ELSE 0 END) OVER (ORDER BY r) AS used FROM entry),
fit AS (SELECT *, bool_and(used <= 8000) OVER (ORDER BY r) AS fits FROM run)"""


@query("result_budget", f"{_mixed(15)} SELECT r AS rank, id, used::BIGINT AS used, fits FROM fit")
def result_budget(spark, d):
    """Which of the best 15 results fit the answer's budget."""
    found = bm25.search(bm25.tokenised(chunks(spark, d)), QUERY, 15)
    p = shaping.previews(_hits(spark, d, found), QUERY)
    text = F.when(F.col("rank") <= 3, F.col("preview")).otherwise(shaping.header())
    w = Window.partitionBy(F.lit(0)).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    e = p.select(F.col("rank").cast("long").alias("rank"), "id", F.length(text).alias("n")).withColumn("used", F.sum(F.col("n") + F.when(F.col("rank") > 1, 2).otherwise(0)).over(w))
    return e.select("rank", "id", "used", (F.min((F.col("used") <= shaping.BUDGET).cast("int")).over(w) == 1).alias("fits"))


@query("shaped_results", f"""{_mixed(15)}, total AS (SELECT count(*) AS n, count(*) FILTER (fits) AS k, max(used) FILTER (fits) AS used, string_agg(t, chr(10) || chr(10) ORDER BY r) FILTER (fits) AS body FROM fit),
note AS (SELECT *, n || ' matches returned; first ' || least(3, n) || ' shown as previews, remaining ' || (n - least(3, n)) || ' summarized.' || chr(10) || chr(10) AS lead, '... ' || (n - k) || ' additional match' || CASE WHEN n - k = 1 THEN '' ELSE 'es' END || ' omitted; use mode: "full" or a narrower query to inspect them ...' AS more, 8000 - used - 2 AS room FROM total),
cut AS (SELECT *, CASE WHEN n > k AND room > 0 THEN body || chr(10) || chr(10) || CASE WHEN length(more) <= room THEN more WHEN room <= 40 THEN more[1:room::INT] ELSE more[1:(room - 27)::INT] || chr(10) || '... output clipped ...' END ELSE body END AS t FROM note)
SELECT 'mixed' AS mode, lead || CASE WHEN length(t) <= 8000 - length(lead) THEN t ELSE t[1:8000 - length(lead) - 27] || chr(10) || '... output clipped ...' END AS text, n > k OR length(t) > 8000 - length(lead) AS truncated FROM cut""")
def shaped_results(spark, d):
    found = bm25.search(bm25.tokenised(chunks(spark, d)), QUERY, 15)
    return shaping.shaped(_hits(spark, d, found), QUERY).select("mode", "text", "truncated")


@query("visible_ranges", f"{_mixed(15).replace(_LINES, f'list_transform({_LINES}, lambda x: x[1:40])')} SELECT id, (a + 1)::BIGINT AS first, z::BIGINT AS last FROM fit WHERE fits AND r <= 3 AND NOT clipped")
def visible_ranges(spark, d):
    """Lines, forty characters of each, that an answer shows whole, which count as seen."""
    found = bm25.search(bm25.tokenised(chunks(spark, d)), QUERY, 15)
    return shaping.shaped(_hits(spark, d, found, 40), QUERY).select(F.explode("ranges").alias("r")).select("r.id", "r.first", "r.last")


@query("auto_mode", "SELECT source AS of, count(*) AS n_hits, CASE WHEN count(*) = 1 AND length(arg_min(text, doc_id)) <= 6000 THEN 'full' WHEN count(*) <= 3 THEN 'preview' ELSE 'mixed' END AS mode FROM documents GROUP BY source")
def auto_mode(spark, d):
    g = chunks(spark, d).groupBy(F.col("path").alias("of")).agg(F.count("*").alias("n_hits"), F.min_by(F.substring("content", 1, shaping.FULL_CHARS + 1), "id").alias("lead"))
    return g.select("of", "n_hits", shaping.automatic_mode(F.col("n_hits"), F.col("lead")).alias("mode"))


@query("compact_signatures", "SELECT id, CASE WHEN length(sig) > 220 THEN sig[1:217] || '...' ELSE sig END AS signature FROM (SELECT doc_id AS id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS sig FROM documents)")
def compact_signatures(spark, d):
    return chunks(spark, d).select("id", compact_signature("content").alias("signature"))

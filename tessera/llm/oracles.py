"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

_WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
_LOWERED = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


_LICENSES = """
WITH lists AS (SELECT doc_id, regexp_extract_all({lowered}, '{word}') AS ws FROM documents),
base(label, phrase) AS (VALUES ('gpl', 'gnu general public license'), ('apache', 'apache license'), ('cc-by', 'cc by'), ('mit', 'mit license')),
template(t, label, sentence, first_phrase, second_phrase) AS (VALUES
  (1, 'agpl', 'gnu affero general public license', 'gnu affero general', ''),
  (2, 'apache-2.0', 'licensed under the apache license version 2 0', 'apache license version', ''),
  (3, 'bsd', 'redistribution and use in source and binary forms with or without modification are permitted', 'source and binary forms', 'without modification'),
  (4, 'cc-by-nc', 'licensed under cc by nc 4 0', 'cc by nc', ''),
  (5, 'cc-by-sa', 'licensed under cc by sa 4 0', 'cc by sa', ''),
  (6, 'gpl', 'free software you can redistribute it and modify it under the terms of the gnu general public license as published by the free software foundation', 'free software foundation', 'gnu general'),
  (7, 'isc', 'permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted', 'modify and distribute this software', ''),
  (8, 'lgpl', 'gnu lesser general public license', 'gnu lesser general', ''),
  (9, 'mit', 'permission is hereby granted free of charge to any person obtaining a copy of this software', 'permission is hereby granted', 'obtaining a copy'),
  (10, 'mpl', 'this source code form is subject to the terms of the mozilla public license', 'mozilla public license', ''),
  (11, 'unlicense', 'this is free and unencumbered software released into the public domain', 'unencumbered software', 'public domain')),
common(w) AS (SELECT unnest(string_split('a and any are as for in into is it of or that the this to use with you', ' '))),
template_word AS (SELECT t, ws[i] AS w, i FROM (SELECT t, ws, unnest(range(1, len(ws) + 1)) AS i FROM (SELECT t, string_split(sentence, ' ') AS ws FROM template)) WHERE ws[i] NOT IN (SELECT w FROM common)),
vocabulary AS (SELECT w FROM template_word UNION SELECT unnest(string_split(phrase, ' ')) FROM base),
word AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS p FROM lists),
hit AS MATERIALIZED (SELECT doc_id, w, p FROM word JOIN vocabulary USING (w)),
weight AS (SELECT w, ln(((SELECT count(*) FROM documents) + 1) / (count(DISTINCT doc_id) + 1.0)) + 1 AS x FROM vocabulary LEFT JOIN hit USING (w) GROUP BY w),
base_word AS (SELECT label, ws[i] AS w, i - 1 AS i, len(ws) AS n FROM (SELECT label, ws, unnest(range(1, len(ws) + 1)) AS i FROM (SELECT label, string_split(phrase, ' ') AS ws FROM base))),
place AS (SELECT doc_id, label, p - i AS s FROM hit JOIN base_word USING (w) GROUP BY doc_id, label, p - i HAVING count(*) = max(n)),
whole AS (SELECT doc_id, ' ' || array_to_string(ws, ' ') || ' ' AS x FROM lists),
verified AS (SELECT doc_id, t, label FROM whole, template WHERE contains(x, ' ' || first_phrase || ' ') AND (second_phrase = '' OR contains(x, ' ' || second_phrase || ' '))),
diagonal AS (SELECT doc_id, t, label, sum(x) AS x FROM verified JOIN template_word USING (t) JOIN hit USING (doc_id, w) JOIN weight USING (w) GROUP BY doc_id, t, label, p - i),
own AS (SELECT doc_id, label, round(max(d.x) / (SELECT sum(x) FROM template_word q JOIN weight USING (w) WHERE q.t = d.t), 6) AS share FROM diagonal d GROUP BY doc_id, t, label),
accepted AS (SELECT doc_id, label, share FROM own WHERE share >= 0.6 UNION ALL SELECT DISTINCT doc_id, label, 1.0::DOUBLE FROM place),
labelled AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score FROM accepted GROUP BY doc_id),
at_base AS (SELECT doc_id, count(*) AS n_base, min(s) AS first_word, max(s) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM place GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM lists LEFT JOIN at_base USING (doc_id) LEFT JOIN labelled USING (doc_id)"""


def license_scans() -> str:
    """Phrases sought in the joined words; shares by grouping on the diagonal. Nothing of it comes from the operator."""
    return _LICENSES.format(lowered=_LOWERED.format("text"), word=_WORD)


def decontamination(window: int = 10) -> str:
    """Windows as joined words; a document's windows of every length that items have are compared with them."""
    return f"""
WITH item AS (SELECT item_id::VARCHAR AS i, regexp_extract_all({_LOWERED.format("text")}, '{_WORD}') AS ws FROM benchmark WHERE item_id IS NOT NULL),
win AS (SELECT DISTINCT i, least({window}, len(ws)) AS n, array_to_string(ws[s:s + least({window}, len(ws)) - 1], ' ') AS x FROM (SELECT i, ws, unnest(range(1, greatest(1, len(ws) - {window} + 1) + 1)) AS s FROM item WHERE len(ws) > 0)),
doc AS (SELECT doc_id, regexp_extract_all({_LOWERED.format("text")}, '{_WORD}') AS ws FROM documents),
place AS (SELECT doc_id, s, n, array_to_string(ws[s:s + n - 1], ' ') AS x FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS s FROM doc, (SELECT DISTINCT n FROM win) WHERE len(ws) >= n)),
found AS (SELECT doc_id, s, n, i FROM place JOIN win USING (n, x)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT i) AS n_items, string_agg(DISTINCT i, ',' ORDER BY i) AS ids FROM found GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)"""


def line_dedup(max_ratio: float = 0.1, min_pages: int = 5, word_chars: int = 6) -> str:
    """``often``: above the ratio itself; ``bad``: above the ratio for its length."""
    return f"""
WITH page AS (SELECT row_number() OVER () AS r, doc_id, source, text, string_split(text, chr(10)) AS ls FROM documents),
line AS (SELECT r, doc_id, source, p, ls[p] AS l, nullif(rtrim(ls[p], ' ' || chr(9) || chr(11) || chr(12) || chr(13)), '') AS k FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS p FROM page)),
counted AS (SELECT source, k, count(DISTINCT r) AS n FROM line WHERE k IS NOT NULL GROUP BY source, k),
host AS (SELECT source, count(*) AS pages FROM documents GROUP BY source),
bad AS (SELECT c.source, c.k, n > {max_ratio}::DOUBLE * pages AS often FROM counted c JOIN host h ON c.source IS NOT DISTINCT FROM h.source WHERE n >= {min_pages} AND n * greatest(1.0::DOUBLE, length(c.k) / {word_chars}.0::DOUBLE) > {max_ratio}::DOUBLE * pages),
told AS (SELECT line.r, line.p, line.l, bad.often, sum(length(line.l)) FILTER (bad.often IS NULL) OVER (PARTITION BY line.r) AS clean, sum(length(line.l)) FILTER (NOT bad.often) OVER (PARTITION BY line.r) AS rare
  FROM line LEFT JOIN bad ON line.source IS NOT DISTINCT FROM bad.source AND line.k = bad.k),
dropped AS (SELECT r, p, l, often IS NOT NULL AND (often OR coalesce(rare, 0) <= 3 * coalesce(clean, 0)) AS gone FROM told),
kept AS (SELECT r, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, coalesce(string_agg(l, chr(10) ORDER BY p) FILTER (NOT gone), '') AS text FROM dropped GROUP BY r)
SELECT doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_dropped, 0)::BIGINT AS n_dropped, kept.text AS text FROM page LEFT JOIN kept USING (r)"""


def chat_formatting() -> str:
    """Conversations as lists of turns; a proper prefix of another list, or an equal one of larger id, goes."""
    return """
WITH turn AS (SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
conv AS (SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn NULLS FIRST, role, text) AS ts FROM turn GROUP BY conv_id),
one AS (SELECT min(conv_id) AS conv_id, count(*) AS n_copies, ts FROM conv GROUP BY ts),
prefix AS (SELECT DISTINCT ts[1:n] AS ts FROM (SELECT ts, unnest(range(1, len(ts))) AS n FROM one))
SELECT conv_id, len(ts)::BIGINT AS n_turns, n_copies::BIGINT AS n_copies,
  array_to_string(list_transform(ts, lambda x: '<|' || x.role || '|>' || chr(10) || replace(x.text, '<|', '< |') || chr(10) || '<|end|>' || chr(10)), '') AS text
FROM one ANTI JOIN prefix USING (ts)"""


def ngram_jaccard(k: int = 3, similarity: int = 90) -> str:
    """All pairs that share a shingle, counted; then what links reach, from the smallest id on."""
    return f"""
WITH RECURSIVE doc AS (SELECT doc_id, regexp_extract_all({_LOWERED.format("text")}, '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
shingle AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) <= {k} THEN array_to_string(ws, ' ') ELSE array_to_string(ws[s:s + {k} - 1], ' ') END AS x
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(1, len(ws) - {k} + 1) + 1)) AS s FROM doc WHERE len(ws) > 0)),
size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingle a JOIN shingle b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM pair JOIN size p ON p.doc_id = a JOIN size q ON q.doc_id = b WHERE 100 * c >= {similarity} * (p.n + q.n - c)),
edge AS MATERIALIZED (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach(doc_id, r) AS (SELECT a, a FROM edge UNION SELECT reach.doc_id, b FROM reach JOIN edge ON edge.a = reach.r)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(c.component_id, d.doc_id) AS component_id FROM doc d LEFT JOIN size USING (doc_id) LEFT JOIN (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id) c USING (doc_id)"""

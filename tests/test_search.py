"""BM25, vectors, fusion and shaping on small cases."""

import math

import pytest
from pyspark.sql import functions as F

from tessera.operators import bm25, fusion, shaping, vector

DOCS = [("src/a.ts", "auth token verify token"), ("src/z.ts", "auth token verify token"), ("src/a.ts.bak", "auth"), ("db.ts", "database pool query"), ("empty", "")]


def toks(spark, docs=DOCS):
    return bm25.tokenised(spark.createDataFrame(docs, "id string, content string"))


def plain_bm25(docs, query):
    words = {i: t.split() for i, t in docs}
    avg = sum(map(len, words.values())) / len(words)
    out = {}
    for q in query.split():
        n = sum(q in w for w in words.values())
        for i, w in words.items():
            if tf := w.count(q):
                out[i] = out.get(i, 0) + math.log(1 + (len(words) - n + 0.5) / (n + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * (len(w) or avg) / avg))
    return sorted(out.items(), key=lambda x: (-round(x[1], 6), x[0]))


@pytest.mark.parametrize("query", ["auth token", "token", "database nothing", "nothing"])
def test_scores(spark, query):
    got = [(r["id"], r["score"]) for r in bm25.search(toks(spark), query).orderBy("bm25_rank").collect()]
    want = plain_bm25(DOCS, query)
    assert [g[0] for g in got] == [w[0] for w in want] and [g[1] for g in got] == pytest.approx([w[1] for w in want])
    index = bm25.build_index(toks(spark))
    again = [(r["id"], r["score"]) for r in bm25.search_index(index, query).orderBy("bm25_rank").collect()]
    assert [x[0] for x in again] == [x[0] for x in got] and [x[1] for x in again] == pytest.approx([x[1] for x in got])


def test_filter_leaves_statistics(spark):
    every = {r["id"]: r["score"] for r in bm25.search(toks(spark), "auth token").collect()}
    some = {r["id"]: r["score"] for r in bm25.search(toks(spark), "auth token", keep=F.col("id") == "src/z.ts").collect()}
    assert some == {"src/z.ts": every["src/z.ts"]}


def test_empty_query_and_corpus(spark):
    assert bm25.search(toks(spark), "").collect() == [] and bm25.search(toks(spark).limit(0), "auth").collect() == []
    assert bm25.corpus_stats(bm25.doc_lengths(toks(spark).limit(0))).first()["avgdl"] == 0


def test_incremental_equals_rebuild(spark):
    index, docs = bm25.build_index(toks(spark)), dict(DOCS)
    for step in range(3):
        gone, new = list(docs)[step], {f"n{step}": f"auth new{step} token", "db.ts": f"database step{step}"}
        docs = {k: v for k, v in docs.items() if k != gone} | new
        index = bm25.updated(index, spark.createDataFrame([(gone,)], "id string"), toks(spark, list(new.items())))
    rebuilt = bm25.build_index(toks(spark, list(docs.items())))
    rows = lambda d: sorted(map(tuple, d.collect()))
    assert rows(index.frequencies.select("term", "df")) == rows(rebuilt.frequencies.select("term", "df"))
    assert rows(index.postings.select("term", "id", "tf")) == rows(rebuilt.postings.select("term", "id", "tf"))
    assert rows(index.lengths.select("id", "dl")) == rows(rebuilt.lengths.select("id", "dl")) and rows(index.stats) == rows(rebuilt.stats)


def test_one_row_an_id(spark):
    d = spark.createDataFrame([(1, "b"), (1, "a"), (2, "c")], "id int, content string")
    assert sorted(map(tuple, bm25.one_row_an_id(d).collect())) == [(1, "b"), (2, "c")]


def vectors(spark):
    return spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.6, 0.8]), ("c", [0.0, 1.0]), ("d", [1.0])], "id string, vector array<float>")


def test_vector_search(spark):
    q = spark.createDataFrame([([1.0, 0.0],)], "q array<float>")
    assert [(r["id"], r["vector_rank"]) for r in vector.search(vectors(spark), q).orderBy("vector_rank").collect()] == [("a", 1), ("b", 2)]
    many = vector.search_many(vectors(spark), spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "qid int, q array<float>"), most_queries=1).collect()
    assert sorted((r["qid"], r["id"], r["rank"]) for r in many) == [(1, "a", 1), (1, "b", 2), (2, "b", 2), (2, "c", 1)]
    n = spark.createDataFrame([(3,)], "n long")
    assert not vector.is_ready(vectors(spark), n, 2).first()["ready"] and vector.is_ready(vectors(spark).where("id <> 'd'"), n, 2).first()["ready"]


def test_fusion(spark):
    lex = spark.createDataFrame([("l", 3.0, ["x"], 1), ("h", 2.0, ["x"], 2)], "id string, score double, matches array<string>, bm25_rank int")
    sem = spark.createDataFrame([("s", 0.9, 1), ("h", 0.8, 2)], "id string, sim double, vector_rank int")
    got = fusion.fuse(lex, sem, limit=3).collect()
    assert [(r["id"], r["signal"]) for r in got] == [("h", "hybrid"), ("l", "lexical"), ("s", "semantic")]
    assert [r["rrf"] for r in got] == pytest.approx([2 / 62, 1 / 61, 1 / 61])
    assert [fusion.rrf_constant(k) for k in (None, 0, 1000, 7.9)] == [60, 1, 200, 7] and [fusion.result_limit(n) for n in (None, 0, 99, 4)] == [5, 1, 15, 4]
    with pytest.raises(ValueError):
        fusion.rrf_constant(float("nan"))
    assert fusion.hybrid_search(toks(spark), "auth", profile="off").collect() == []
    assert {r["signal"] for r in fusion.hybrid_search(toks(spark), "auth", vectors(spark), None).collect()} == {"lexical"}


def hits(spark, n, lines=3, width=20, name="f"):
    text = lambda i: "\n".join(f"line {j} of {i} " + "w" * width + (" needle" if j == lines // 2 else "") for j in range(lines))
    rows = [(i + 1, f"c{i}", f"src\\{name}{i}.ts", "function", f"fn{i}", f"function fn{i}()", "// crumb", 1, lines, text(i), "lexical", ["needle"]) for i in range(n)]
    return spark.createDataFrame(rows, "rank int, id string, path string, kind string, symbol string, signature string, breadcrumb string, start_line int, end_line int, content string, signal string, matches array<string>")


@pytest.mark.parametrize(("n", "mode"), [(1, "full"), (3, "preview"), (8, "mixed")])
def test_modes(spark, n, mode):
    r = shaping.shaped(hits(spark, n), "needle").first()
    assert r["mode"] == mode and not r["truncated"] and len(r["text"]) <= 8000
    assert len(r["ranges"]) == min(n, 3)
    if mode == "mixed":
        assert r["text"].startswith("8 matches returned; first 3 shown as previews, remaining 5 summarized.\n\nsrc/f0.ts:1-3 [function] fn0 — function fn0() [lexical]; matches: needle\n```ts\n")


def test_previews_hold_the_best_line(spark):
    r = shaping.previews(hits(spark, 1, lines=100), "needle Needle").first()
    assert (r["best"], r["first"], r["last"]) == (50, 48, 60) and "needle" in r["body"]
    assert r["body"].startswith("... lines 1-48 omitted ...\n") and r["body"].endswith("\n... lines 61-100 omitted ...")
    wide = shaping.previews(hits(spark, 1, lines=20, width=300), "needle").first()
    assert wide["clipped"] and wide["body"].endswith("\n... preview clipped ...") and len(wide["body"]) == 1400 + 24


@pytest.mark.parametrize("n", [15, 100])
def test_budget(spark, n):
    long = hits(spark, n, lines=12, width=100, name="long" * 40)
    r = shaping.shaped(long, "needle", mode="preview").first()
    assert r["truncated"] and len(r["text"]) <= 8000 and " additional match" in r["text"]
    assert len(shaping.shaped(long, "needle").first()["text"]) <= 8000
    s = shaping.shaped(hits(spark, 2), "needle", mode="summary").first()
    assert s["mode"] == "summary" and s["ranges"] == []
    f = shaping.shaped(long, "needle", mode="full").first()
    assert len(f["text"]) > 8000 and len(f["ranges"]) == n

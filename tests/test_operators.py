"""Intervals, maintenance, windows, sessions and matching on small cases."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import edits, intervals, maintenance, matching, output_window, sessions, vector


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


# --- intervals
@pytest.mark.parametrize("salted", [0, 3])
def test_merge(spark, salted):
    d = spark.createDataFrame([("a", 1, 3), ("a", 2, 2), ("a", 4, 6), ("a", 9, 9), ("b", 1, 10), ("b", 5, 7), ("b", 0, 4), ("b", 8, 2)], "k string, start long, stop long")
    assert rows(intervals.merge(d, ["k"], salted=salted)) == [("a", 1, 6), ("a", 9, 9), ("b", 1, 10)]


def test_merge_matches_plain_sets(spark):
    draw = random.Random(6)
    spans = [(draw.randrange(3), s := draw.randrange(1, 60), s + draw.randrange(6)) for _ in range(200)]
    d = spark.createDataFrame(spans, "k long, start long, stop long")
    for merged in (intervals.merge(d, ["k"]), intervals.merge(d, ["k"], salted=7)):
        got = merged.collect()
        for k in range(3):
            lines = {x for kk, s, e in spans if kk == k for x in range(s, e + 1)}
            assert {x for r in got if r["k"] == k for x in range(r["start"], r["stop"] + 1)} == lines
            assert all(r["stop"] + 1 not in lines and r["start"] - 1 not in lines for r in got if r["k"] == k)


def test_points_cover_shift_nearest(spark):
    p = spark.createDataFrame([("a", 3.0), ("a", 1.0), ("a", 2.0), ("a", 2.0), ("a", 7.0), ("a", 0.0)], "k string, line double")
    assert rows(intervals.from_points(p, ["k"])) == [("a", 1, 3), ("a", 7, 7)]
    seen = spark.createDataFrame([("a", 1, 5), ("a", 6, 8)], "k string, start long, stop long")
    want = spark.createDataFrame([("a", 2, 8), ("a", 20, 21)], "k string, start long, stop long")
    assert rows(intervals.covered(want, seen, ["k"])) == [("a", 2, 1, False)]
    assert rows(intervals.covered(want, seen, ["k"], spark.createDataFrame([("a", True)], "k string, complete boolean"))) == [("a", 2, 1, True)]
    assert rows(intervals.uncovered(want, seen, ["k"])) == [("a", 20, 21)]
    edits = intervals.edit_summary(spark.createDataFrame([("a", 2, 3, 5)], "k string, start long, stop long, n_new long"), ["k"])
    assert rows(intervals.shifted(spark.createDataFrame([("a", 1, 3), ("a", 4, 9), ("b", 4, 4)], "k string, start long, stop long"), edits, ["k"])) == [("a", 1, 3), ("a", 7, 12), ("b", 4, 4)]
    t, h = spark.createDataFrame([("a", 10), ("a", 50)], "k string, line long"), spark.createDataFrame([("a", 8), ("a", 12), ("a", 47)], "k string, hit long")
    assert rows(intervals.nearest(t, h, ["k"])) == [("a", 10, 8, 2)]


def test_overlaps(spark):
    d = spark.createDataFrame([("a", 1, 1, 9), ("a", 2, 3, 4), ("a", 3, 8, 12), ("a", 4, 20, 20)], "k string, i long, start long, stop long")
    assert rows(intervals.overlaps(d, ["k"])) == [("a", 1, 2), ("a", 1, 3)]
    assert rows(intervals.overlapping_pairs(d, ["k"])) == [("a", 1, 2), ("a", 1, 3)]
    side = lambda xs: spark.createDataFrame(xs, "k string, start long, stop long, complete boolean, total long")
    assert rows(intervals.union(side([("a", 1, 3, False, None)]), side([("a", 4, 99, False, 10)]), ["k"])) == [("a", 1, 10, False, 10)]


# --- maintenance
def test_difference_and_plan(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", None), ("d", "1")], "path string, hash string")
    new = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", None), ("e", "1")], "path string, hash string")
    assert {r["path"]: r["change"] for r in maintenance.difference(old, new).collect()} == {"a": "same", "b": "changed", "c": "same", "d": "deleted", "e": "added"}
    lacks = spark.createDataFrame([("a",)], "path string")
    assert {r["path"]: r["action"] for r in maintenance.sync_plan(old, new, lacks).collect()} == {"a": "reindex", "b": "reindex", "c": "keep", "d": "delete", "e": "reindex"}
    assert maintenance.same_snapshot(old, old).first()["equal"] and not maintenance.same_snapshot(old, new).first()["equal"]
    assert rows(maintenance.without_paths(spark.createDataFrame([("a.ts", 1), ("a.ts.bak", 2)], "path string, n int"), spark.createDataFrame([("a.ts",)], "path string"))) == [("a.ts.bak", 2)]


def test_reuse_latest_retain(spark):
    new = spark.createDataFrame([("x", "h"), ("y", "z")], "id string, hash string")
    old = spark.createDataFrame([("h", [1.0], 1), ("h", [2.0], 2)], "hash string, vector array<float>, seq int")
    assert {r["id"]: r["vector"] for r in maintenance.reused_vectors(new, old).collect()} == {"x": [2.0], "y": None}
    c = spark.createDataFrame([("p", 1, "a"), ("p", 3, None), ("p", 2, "b")], "path string, generation long, content string")
    assert rows(maintenance.latest(c, ["path"], ["generation"])) == [("p", 3, None)]
    f = spark.createDataFrame([("k", f"n{i}", i, 10) for i in range(6)], "k string, name string, mtime int, size long")
    assert [r["name"] for r in maintenance.retained(f, ["k"], most_files=4, most_bytes=35).orderBy("name").collect()] == ["n3", "n4", "n5"]


def test_skipping_budget(spark):
    d = spark.createDataFrame([("k", i, s) for i, s in enumerate([5, 9, 4, 3, 8, 1])], "k string, o int, s long")
    assert [r["s"] for r in maintenance.admitted(d, ["k"], "o", "s", 12).where("kept").orderBy("o").collect()] == [5, 4, 3]
    assert [r["s"] for r in maintenance.admitted(d.withColumn("c", F.lit(2)), ["k"], "o", "s", 100, "c", 5).where("kept").orderBy("o").collect()] == [5, 9]


def test_constraints(spark):
    from tessera.functions.text import content_hash

    c = spark.createDataFrame([("a.py:1-2#f", "a.py", 1, 2, "f", "function", "x"), ("bad", "../b", 3, 2, "", "struct", "y"), ("bad", "a.py", 1, 1, "", "file", "z")], "id string, path string, start long, stop long, symbol string, kind string, content string").withColumn("hash", F.when(F.col("content") == "z", "0").otherwise(content_hash("content")))
    files = spark.createDataFrame([("a.py", "h"), ("c.py", "h")], "path string, hash string")
    manifest = spark.createDataFrame([(2, "g")], "version int, generation string")
    got = {r["rule"]: r["n"] for r in maintenance.violations(c, files, manifest, generation="g").collect()}
    assert got == {"id_from_parts": 2, "kind": 1, "path": 1, "lines": 1, "hash": 1, "hash_format": 1, "most_chunks": 0, "unique_id": 1, "known_file": 1, "file_has_chunk": 1, "manifest": 1}
    src = spark.createDataFrame([("a.py", "x\nq")], "path string, content string")
    part = spark.createDataFrame([("1", "a.py", 1, 1, "x"), ("2", "a.py", 2, 2, "x")], "id string, path string, start int, stop int, content string")
    assert rows(maintenance.text_matches_source(part, src)) == [("a.py", "1", True), ("a.py", "2", False)]
    st = maintenance.staleness(spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "path string, file_hash string"), spark.createDataFrame([("a", "1"), ("b", "2")], "path string, hash string"))
    assert rows(st) == [("a", "fresh"), ("b", "stale"), ("c", "gone")]


# --- windows
def outputs(spark, text, command="cat x", is_error=None):
    return spark.createDataFrame([(1, text, command, is_error)], "id int, text string, command string, is_error boolean")


def test_head_and_tail(spark):
    r = output_window.clamp_outputs(outputs(spark, "\n".join(f"l{i}" for i in range(1, 151))), max_lines=40).first()
    assert r["truncated"] and (r["total"], r["shown"]) == (150, 40)
    assert "l20\n\n[... 110 lines omitted (lines 21–130) ...]\n\nl131" in r["text"] and "[Truncated: 40/150 lines. Full: spill/" in r["text"]
    same = output_window.clamp_outputs(outputs(spark, "a\nb")).first()
    assert (same["text"], same["truncated"], same["shown"]) == ("a\nb", False, 2)


def test_wide_and_budget(spark):
    r = output_window.clamp_outputs(outputs(spark, "x" * 50_000)).first()
    assert len(r["text"]) < 1000 and "49,760 chars omitted" in r["text"]
    r = output_window.clamp_outputs(outputs(spark, "\n".join(["y" * 100] * 10)), max_bytes=500).first()
    assert r["returned_bytes"] <= 500 and r["truncated"]
    r = output_window.clamp_outputs(outputs(spark, "\n".join(["日" * 300] * 40))).first()
    assert r["returned_bytes"] <= 20480 and "�" not in r["text"]
    assert output_window.clamp_outputs(outputs(spark, "z" * 5000), max_bytes=5).first()["text"] == "[Trun"
    with pytest.raises(ValueError):
        output_window.clamp_outputs(outputs(spark, "a"), max_bytes=-1)


@pytest.mark.parametrize(("command", "is_error", "shown"), [("run", True, True), ("npm test", None, True), ("npm test", False, False), ("grep x", True, False), ("cat", None, False)])
def test_failure_window(spark, command, is_error, shown):
    lines = [f"l{i}" for i in range(200)]
    lines[100] = "FAIL src/a.test.ts"
    got = {r["line"] for r in output_window.shown_lines(outputs(spark, "\n".join(lines), command, is_error), ["id"], max_lines=20).collect()}
    assert ("FAIL src/a.test.ts" in got) == shown and len(got) == 20


def test_footers(spark):
    t = "body\n\n[Truncated: 3/9 lines. Full: /tmp/x.log (use offset/limit with read if needed)]"
    f = outputs(spark, t).select(output_window.prior_footer("text").alias("f")).first()["f"]
    assert (f["kind"], f["path"], f["text"]) == ("own", "/tmp/x.log", "body")
    h = outputs(spark, "body\n[Showing lines 1-5 of 9. Full output: /tmp/o.log]").select(output_window.prior_footer("text").alias("f")).first()["f"]
    assert (h["kind"], h["path"], h["text"]) == ("host", "/tmp/o.log", "body")
    again = output_window.clamp_outputs(outputs(spark, t)).first()
    assert again["truncated"] and again["text"].count("[Truncated") == 1 and again["spill_path"] == "/tmp/x.log"


def test_reading(spark):
    f = spark.createDataFrame([("a", "1\n22\n333\n4444\n")], "path string, content string")
    assert [tuple(r) for r in output_window.line_window(f, ["path"], offset=2, limit=9, most_bytes=6).orderBy("n").collect()] == [("a", 2, "22"), ("a", 3, "333")]
    b = spark.createDataFrame([("q", i, "x" * 10) for i in range(5)], "q string, seq int, content string")
    assert output_window.batch_read(b, ["q"], most_bytes=25).count() == 3
    a = spark.createDataFrame([(True, None, "plain", None, None, False), (None, None, "anchored", None, None, False), (None, True, "anchored", None, None, True), (None, None, None, "line-range", True, True), (None, None, None, None, True, True), (None, None, None, None, True, False)], "a boolean, r boolean, m string, b string, d boolean, t boolean")
    assert [r[0] for r in a.select(output_window.uses_anchors(*(F.col(c) for c in "armbdt"))).collect()] == [True, True, False, False, True, False]


# --- sessions
def test_measures_and_repair(spark):
    lines = [
        '{"type":"message","message":{"role":"assistant","content":[{"type":"toolCall","name":"code_search"},{"type":"toolCall"}],"usage":{"input":5,"output":2}}}',
        '{"type":"message","message":{"role":"toolResult","toolName":"code_search","content":[{"type":"text","text":"[code_search auto]\\na.md:3 x"}]}}',
        '{"type":"compaction","usage":{"input":1,"cost":{"total":"x"}}}', "not json {", "", '{"type":"message","message":{"usage":{"cost":{"total":0.5}}}}',
    ]
    d = sessions.entries(spark.createDataFrame([("s", x) for x in lines], "s string, value string"))
    m = sessions.measured(d, ["s"]).first()
    assert m["calls"] == {"code_search": 1, "unknown": 1} and m["chars"] == {"code_search": 27} and (m["modes"], m["prose_lines"]) == (["[code_search auto]"], 1)
    assert rows(sessions.usage_totals(d, ["s"])) == [("s", 5.0, 2.0, 0.0)]
    text = "\r\n".join(lines)
    files = spark.createDataFrame([("p", text), ("big", "x" * 50), ("ok", "{}")], "path string, content string")
    fixed = sessions.repaired(files, most_bytes=2000)
    r = {x["path"]: x for x in fixed.collect()}
    assert (r["p"]["state"], r["p"]["n"], r["ok"]["state"]) == ("candidate", 2, "clean") and r["p"]["text"].count("\r\n") == 5 and "not json {" in r["p"]["text"]
    assert sessions.repaired(files.withColumn("content", F.lit(r["p"]["text"]))).where("state = 'candidate'").count() == 0
    changed = files.withColumn("content", F.concat("content", F.lit("!")))
    assert sessions.to_write(fixed, changed).count() == 0 and sessions.to_write(fixed, files).count() == 1
    assert tuple(sessions.repair_stats(fixed).first()) == (3, 1, 0, 2, 0, True)
    assert tuple(sessions.repair_stats(fixed, sessions.to_write(fixed, files)).first()) == (3, 1, 1, 2, 0, False)


def test_debounce(spark):
    from datetime import datetime, timedelta

    t0 = datetime(2024, 1, 1)
    e = spark.createDataFrame([("k", t0 + timedelta(milliseconds=m)) for m in (0, 400, 800, 1200, 1600, 2000, 2400, 5000)], "k string, ts timestamp")
    assert sorted(r["n"] for r in sessions.debounced(e, ["k"]).collect()) == [1, 7]
    assert sorted(r["n"] for r in sessions.debounced(e, ["k"], cap_ms=2000).collect()) == [1, 2, 5]


# --- matching
def located(spark, content, search, hint=None, replace="R"):
    d = spark.createDataFrame([(1, content, search, replace, hint)], "id int, content string, search string, replace string, line_hint int")
    return matching.applied(matching.located(d)).first()


@pytest.mark.parametrize(
    ("content", "search", "hint", "strategy", "span", "new"),
    [
        ("a\nb\nc", "b", None, "exact", (2, 2), "a\nR\nc"),
        ("a\r\nb\r\nc", "a\nb", None, "exact", (1, 2), "R\r\nc"),
        ("x\ny\nx", "x", None, "none", (None, None), "x\ny\nx"),
        ("x\ny\nx", "x", 3, "exact", (3, 3), "x\ny\nR"),
        ("x\ny\nx", "x", 2, "exact", (1, 1), "R\ny\nx"),
        ("aaa", "aa", None, "none", (None, None), "aaa"),
        ("  p\n\tq \nr", "p\nq", None, "whitespace_normalized", (1, 2), "R\nr"),
        ("p \np ", "p\n", None, "none", (None, None), "p \np "),
        ("function alpha(first, second)\nother", "function alpha(first, secnd)", None, "fuzzy", (1, 1), "R\nother"),
        ("abcdefghij\nabcdefghik", "abcdefghix", None, "none", (None, None), "abcdefghij\nabcdefghik"),
        ("a", "  ", None, "none", (None, None), "a"),
        ("short", "much longer\nthan that", None, "none", (None, None), "short"),
    ],
)
def test_location(spark, content, search, hint, strategy, span, new):
    r = located(spark, content, search, hint)
    assert (r["strategy"], (r["first"], r["last"]), r["new_content"]) == (strategy, span, new)
    assert (r["error"] is None) == (strategy != "none")


def test_common_share_matches_plain():
    def lcs(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    draw = random.Random(9)
    for _ in range(300):
        a, b = ("".join(draw.choice("abc") for _ in range(draw.randrange(12))) for _ in range(2))
        assert matching.common_share(a, b) == pytest.approx(lcs(a, b) / max(len(a), len(b)) if a != b else 1)


def test_several_blocks(spark):
    schema = "batch string, path string, id int, content string, search string, replace string, line_hint int"
    text = "one\ntwo\nthree\nfour"
    d = spark.createDataFrame([("b", "p", 1, text, "two", "2\n2", None), ("b", "p", 2, text, " four", "4", None), ("c", "q", 1, text, "one\ntwo", "x", None), ("c", "q", 2, text, "two", "y", None), ("c", "r", 1, text, "one", "z", None)], schema)
    found = matching.located(d)
    one = {r["path"]: r for r in matching.apply_blocks(found).collect()}
    assert (one["p"]["ok"], one["p"]["new_content"]) == (True, "one\n2\n2\nthree\n4") and (one["q"]["error"], one["q"]["new_content"]) == ("blocks overlap", text)
    every = {r["path"]: r for r in matching.edit_files(found).collect()}
    assert every["p"]["ok"] and not every["r"]["ok"] and every["r"]["new_content"] == text
    assert rows(matching.duplicates(d, ["batch", "path"])) == [("b", "p", 2), ("c", "q", 2)]
    s = spark.createDataFrame([("p", 1, 2, 3, 5), ("p", 2, 8, 8, 0)], "path string, seq int, first long, last long, n_new long")
    assert [r["now_first"] for r in matching.shifted_lines(s, ["path"]).orderBy("seq").collect()] == [2, 11]
    assert matching.unified_diff("a\nb", "a\nc").split("\n")[-2:] == ["-b", "+c"]


def test_structure_knows_patterns():
    for good in ("const x = /[{]/;", "a = b / c; d = (e) / f", "return /\\)/.test(x)", "f(/[/)]{2}/g, '{')", "// {\nlet a = 1 /* ( */", "x = `{`"):
        assert edits.structure_error(good) is None, good
    assert edits.structure_error("a = b / (c\n") == "line 1: ( is not closed"
    assert edits.structure_error("let x = /a/;\n}") == "line 2: unexpected }"


def test_blocks_are_found_in_files(spark):
    files = [(1, "a\n  long line here \nb\nlong line here\nb"), (2, "long line here\nc"), (3, None), (4, "x\r\nlong line here\r\nb")]
    blocks = [(10, "long line here\n b"), (11, "  \n"), (12, "long line here\nb\nlong line here\nb"), (13, "nowhere"), (14, "long line here\nb\n")]
    got = matching.blocks_in(spark.createDataFrame(files, "id int, content string"), spark.createDataFrame(blocks, "block int, search string"))
    assert sorted(map(tuple, got.collect())) == [(1, 10, 1), (1, 10, 3), (1, 12, 1), (4, 10, 1)]


def test_many_vector_queries_in_blocks(spark):
    vectors = spark.createDataFrame([(i, [float(i % 7 == j) for j in range(7)]) for i in range(70)], "id long, vector array<double>")
    queries = spark.createDataFrame([(f"q{j}", [float(k == j) for k in range(7)]) for j in range(7)], "qid string, q array<double>")
    one, many = (sorted(map(tuple, vector.search_many(vectors, queries, 0.5, 3, most).collect())) for most in (100, 2))
    assert one == many and len(one) == 21 and {r[1] % 7 for r in one if r[0] == "q3"} == {3}
    assert vector.search_many(vectors, queries.limit(0)).collect() == []


def test_symbols_that_an_index_lacks(spark):
    wanted = spark.createDataFrame([("a.py", ["x", "y"]), ("b.py", ["z"]), ("c.py", [])], "path string, symbols array<string>")
    chunks = spark.createDataFrame([("a.py", "y"), ("a.py", "other"), ("c.py", "q"), ("d.py", "z")], "path string, symbol string")
    got = {r["path"]: (r["covered"], r["missing"]) for r in maintenance.missing_symbols(wanted, chunks).collect()}
    assert got == {"a.py": (True, ["x"]), "b.py": (False, ["z"]), "c.py": (True, [])}


def test_only_files_that_are_still_what_was_read_are_written(spark):
    changed = spark.createDataFrame([("a", "1", "2"), ("b", "1", "2"), ("c", "1", "1"), ("gone", "1", "2")], "path string, content string, new_content string")
    current = spark.createDataFrame([("a", "1"), ("b", "changed"), ("c", "1")], "path string, content string")
    assert [(r["path"], r["new_content"]) for r in matching.to_write(changed, current).collect()] == [("a", "2")]

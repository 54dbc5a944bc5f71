"""Functions on strings, lines and vectors."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.functions import lines as L
from tessera.functions import text as T
from tessera.functions import vectors as V


def values(spark, expr, rows, schema="x string"):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr).collect()]


def test_tokens(spark):
    cases = {"fooBar_baz": ["foobar_baz", "foobar", "baz", "foo", "bar_baz"], "HTTPServer": ["httpserver"], "a I x1": ["x1"], "": [], "__a__bc": ["__a__bc", "bc"], "verifySignature ok": ["verifysignature", "verify", "signature", "ok"]}
    assert values(spark, T.tokens("x"), [(k,) for k in cases]) == list(cases.values())
    assert [T.query_tokens(k) for k in cases] == list(cases.values())
    assert values(spark, T.tokens("x"), [(None,)]) == [[]]


def test_stopwords(spark):
    assert T.query_terms("the of") == ["the", "of"] and T.query_terms("the cat of cat") == ["cat"]
    assert values(spark, T.without_stopwords(F.split("x", " ")), [("the of",), ("the cat",)]) == [["the", "of"], ["cat"]]


def test_paths(spark):
    assert values(spark, T.extension("x"), [("a/b.TS",), (".bashrc",), ("a/.x.py",), ("none",), ("a.b/c",), ("a\\b.rs",)]) == [".TS", "", ".py", "", "", ".rs"]
    safe = {"a/b.c": True, "": False, "/a": False, "a//b": False, "a/../b": False, "./a": False, "c:x": False, "a\\b": False, "a\x00": False}
    assert values(spark, T.is_safe_path("x"), [(k,) for k in safe]) == list(safe.values())
    test = {"src/tests/a.ts": True, "a.test.ts": True, "test_x.py": True, "src/x.ts": False, "spec/a": True, "a_test.go": True}
    assert values(spark, T.is_test_path("x"), [(k,) for k in test]) == list(test.values())
    assert values(spark, T.path_contains("x", "SRC\\a"), [("x/src/A.ts",), ("src",)]) == [True, False]
    assert values(spark, T.path_contains("x", ""), [("x",)]) == [True]
    assert values(spark, T.language_of("x"), [("a.py",), ("a",)]) == ["py", "text"]


def test_shapes(spark):
    assert values(spark, T.compact_signature("x"), [("a \n b ",), ("x" * 221,)]) == ["a b", "x" * 217 + "..."]
    assert values(spark, T.compact_message("x"), [("x" * 241,)]) == ["x" * 239 + "…"]
    assert values(spark, T.clip_to_budget(F.col("x"), 40), [("y" * 41,)]) == ["y" * 40]
    assert values(spark, T.clip_to_budget(F.col("x"), 50), [("y" * 51,), ("y" * 50,)]) == ["y" * 23 + "\n... output clipped ...", "y" * 50]
    assert values(spark, T.clamp_width("x", F.lit(7), 100), [("z" * 2000,), ("z" * 100,)]) == ["z" * 40 + "... <line 7 truncated: 1,960 chars omitted>", "z" * 100]
    assert values(spark, T.truncate_to_width("x", 3), [("\x1b[31mabcd\x1b[0m",), ("ab",)]) == ["ab…", "ab"]
    assert values(spark, T.first_few(F.split("x", ","), 2), [("a,b,c,d",), ("a",)]) == ["a, b +2 more", "a"]
    assert values(spark, T.with_line_ends(F.col("x"), F.lit(True)), [("a\nb\r\nc",)]) == ["a\r\nb\r\nc"]
    counts = {-1.0: "0", 999.0: "999", 1200.0: "1.2k", 45000.0: "45k", 1.25e6: "1.3M", 2.5e7: "25M"}
    assert values(spark, T.format_count("x"), [(k,) for k in counts], "x double") == list(counts.values())
    assert values(spark, T.load_level("x"), [(91,), (71,), (70,)], "x int") == ["critical", "warning", "good"]


def test_commands(spark):
    seen = {"grep x": True, "cat a | GREP b": True, "LS": True, "cat a": False, "whichever": False, "which a": True}
    assert values(spark, T.is_discovery_command("x"), [(k,) for k in seen]) == list(seen.values())
    assert values(spark, T.is_execution_command("x"), [("npm test",), ("cargo run",), ("cat",), (None,)]) == [True, True, False, False]
    lines = {"FAIL src/a": (True, True), "  --> a.rs:1:2": (True, True), "TypeError: x": (True, False), "error[E01]: x": (True, True), "fine": (False, False)}
    assert list(zip(values(spark, T.is_diagnostic("x", True), [(k,) for k in lines]), values(spark, T.is_diagnostic("x", False), [(k,) for k in lines]), strict=True)) == list(lines.values())


def fnv(before, line, after):
    h = 0x811C9DC5
    for i, part in enumerate((before, line, after)):
        units = part.replace("\r", "").rstrip().encode("utf-16-le")
        for u in [0] * bool(i) + [units[j] | units[j + 1] << 8 for j in range(0, len(units), 2)]:
            h = ((h ^ u) * 0x01000193) & 0xFFFFFFFF
    return f"{h & 255:02X}"


def test_line_hashes(spark):
    draw = random.Random(4)
    texts = ["", "a", "a\nb", "x \t\r\ny", "😀 é\n\n日本"] + ["\n".join("".join(draw.choice("aé😀 {}\t") for _ in range(draw.randrange(9))) for _ in range(5)) for _ in range(20)]
    want = []
    for t in texts:
        ls = t.split("\n")
        want.append([fnv(ls[i - 1] if i else "", x, ls[i + 1] if i + 1 < len(ls) else "") for i, x in enumerate(ls)])
    assert values(spark, L.line_hashes("x"), [(t,) for t in texts]) == want
    one = L.line_hash(F.lit("a"), F.col("x"), F.lit(None).cast("string"))
    assert values(spark, one, [("b😀 ",), ("",)]) == [fnv("a", "b😀 ", ""), fnv("a", "", "")]


def test_anchors(spark):
    refs = {"42": (42, None), " 42#3f ": (42, "3F"), "7#AA│code": (7, "AA"), "0": None, "x": None, "5#Z1": None}
    got = values(spark, L.parse_anchor("x"), [(k,) for k in refs])
    assert [None if g is None else tuple(g) for g in got] == list(refs.values())
    spans = spark.createDataFrame([("a\nb\nc", 2, 2), ("a\nb\nc", 0, 1), ("ab", 0, 2)], "c string, s int, n int").select(L.line_span(F.col("c"), F.col("s"), F.col("n"))).collect()
    assert [tuple(r[0]) for r in spans] == [(2, 2), (1, 1), (1, 1)]


def test_vectors(spark):
    rows = [([3.0, 4.0], [1.0, 2.0]), ([1.0], [1.0, 2.0])]
    d = spark.createDataFrame(rows, "a array<float>, b array<float>")
    assert [r[0] for r in d.select(V.dot(F.col("a"), F.col("b"))).collect()] == [11.0, 0.0]
    draw = random.Random(1)
    v = [draw.random() for _ in range(12)]
    got = spark.createDataFrame([(v,)], "v array<double>").select(V.layer_norm_slice(F.col("v"), 5)).first()[0]
    mu = sum(v) / 12
    z = [(x - mu) / math.sqrt(sum((y - mu) ** 2 for y in v) / 12 + 1e-5) for x in v[:5]]
    assert got == pytest.approx([x / math.sqrt(sum(y * y for y in z)) for x in z])
    ok = spark.createDataFrame([([1.0, 2.0],), ([1.0],), ([1.0, float("nan")],), ([1.0, float("inf")],), (None,)], "v array<float>").select(V.is_usable(F.col("v"), 2)).collect()
    assert [r[0] for r in ok] == [True, False, False, False, False]


def test_hash_is_of_utf8(spark):
    import hashlib

    assert values(spark, T.content_hash("x"), [("é",)]) == [hashlib.sha256("é".encode()).hexdigest()[:16]]
    assert re.fullmatch("[0-9a-f]{16}", values(spark, T.content_hash("x"), [("",)])[0])


def test_containment(spark):
    from tessera.functions.text import is_inside

    paths = {"/w/a": True, "/w": True, "/w/../x": False, "/w/./a/../b": True, "/wx/a": False, "w/a": False, "/tmp/x": True, "/w/a/../../w/b": True, "\\w\\a": True}
    got = spark.createDataFrame([(p,) for p in paths], "p string").select("p", is_inside("p", ["/w/", "/tmp"]).alias("ok")).collect()
    assert {r["p"]: r["ok"] for r in got} == paths

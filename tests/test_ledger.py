"""The evidence ledger, edits by anchors, verification and mending."""

import pytest
from pyspark.sql import functions as F

from tessera.functions.lines import line_hashes
from tessera.operators import edits, ledger

EVIDENCE = "session string, path string, kind string, fingerprint string, complete boolean, ranges array<struct<start: bigint, stop: bigint>>, total long, provenance string, query string, hits array<struct<line: bigint, text: string>>"
REQUEST = "req int, session string, path string, op string, inside boolean, exists boolean, regular boolean, enforced boolean, fingerprint string, targets array<struct<start: bigint, stop: bigint>>, blocks array<string>"
LONG = "a first line of code\nand a second line of it"


def judged(spark, kind="read", seen=((7, 12),), hits=(9, 10), complete=False, total=100, **change):
    ev = spark.createDataFrame([("s", "p", kind, "f", complete, list(seen), total, "search", None, [(h, "") for h in hits])], EVIDENCE)
    q = {"req": 1, "session": "s", "path": "p", "op": "edit", "inside": True, "exists": True, "regular": True, "enforced": True, "fingerprint": "f", "targets": [(8, 9)], "blocks": ["x"]} | change
    r = ledger.authorised(spark.createDataFrame([tuple(q.values())], REQUEST), ev).first()
    return r["rule"], r["tier"], (r["hint_offset"], r["hint_limit"]), [tuple(x) for x in r["gained"]]


@pytest.mark.parametrize(
    ("change", "rule", "tier"),
    [
        ({"path": ""}, "deny: empty path", None),
        ({"inside": False}, "deny: outside", None),
        ({"regular": False}, "deny: not a file", None),
        ({"exists": False}, "deny: missing", None),
        ({"exists": False, "op": "write"}, "allow", None),
        ({"enforced": False}, "allow", None),
        ({"session": "t"}, "deny: uninspected", None),
        ({"fingerprint": "g"}, "deny: stale", None),
        ({"op": "write"}, "allow", None),
        ({"op": "write", "kind": "search"}, "deny: read before write", None),
        ({"op": "write", "kind": "search", "complete": True}, "allow", None),
        ({"targets": [(8, 101)]}, "deny: malformed target", None),
        ({"targets": [(9, 8)]}, "deny: malformed target", None),
        ({"blocks": [" \n"]}, "deny: empty block", None),
        ({}, "allow: seen", 1),
        ({"kind": "search"}, "allow: seen", 1),
        ({"targets": [(8, 13)], "seen": []}, "deny: not covered", None),
        ({"targets": [(7, 12)], "seen": []}, "allow: seen", 1),
        ({"targets": [(11, 13)], "seen": []}, "allow: seen", 1),
        ({"targets": [(11, 18)], "seen": []}, "deny: not covered", None),
        ({"targets": [(50, 52)], "blocks": [LONG]}, "allow: substantive", 2),
        ({"targets": [(8, 9), (50, 52)], "blocks": ["x", LONG]}, "allow: substantive", 2),
        ({"targets": [(50, 52), (8, 9)], "blocks": ["x", ""]}, "deny: not covered", None),
        ({"targets": [(8, 9)], "blocks": []}, "allow: seen", 1),
        ({"targets": [(8, 9)], "blocks": [], "kind": "search"}, "deny: search only", None),
        ({"targets": [(50, 52)], "blocks": []}, "deny: not covered", None),
        ({"targets": [(50, 52)], "blocks": [LONG, LONG]}, "allow: substantive", 2),
        ({"targets": [(50, 52)], "blocks": [LONG, "x"]}, "deny: not covered", None),
        ({"targets": [(7, 12)], "blocks": [], "seen": []}, "allow: seen", 1),
    ],
)
def test_rules(spark, change, rule, tier):
    assert judged(spark, **change)[:2] == (rule, tier)


def test_hints_and_gains(spark):
    assert judged(spark, fingerprint="g", targets=[(40, 90)])[2] == (38, 55)
    assert judged(spark, targets=[(95, 98)])[2] == (95, 6)
    assert judged(spark, targets=[(50, 60)], total=None)[2] == (50, 15)
    assert judged(spark, targets=[(11, 13)], seen=[])[3] == [(11, 13)]
    # what one block gains, a later one may use
    assert judged(spark, targets=[(11, 13), (12, 13)], blocks=["x", "y"], seen=[])[:2] == ("allow: seen", 1)


def test_record_and_mutation(spark):
    obs = spark.createDataFrame(
        [
            ("s", "p", "read", "old", True, [(1, 9)], 9, "read", None, [], 1),
            ("s", "p", "search", "new", False, [(1, 3)], None, "search", "q", [(2, "a")], 2),
            ("s", "p", "search", "new", False, [(4, 99)], 20, "search", None, [(2, "b"), (5, "c")], 3),
        ],
        EVIDENCE + ", seq int",
    )
    r = ledger.recorded(obs).first()
    assert (r["kind"], r["complete"], r["total"], r["query"], r["fingerprint"]) == ("search", False, 20, "q", "new")
    assert [tuple(x) for x in r["ranges"]] == [(1, 20)] and [tuple(x) for x in r["hits"]] == [(2, "b"), (5, "c")]
    moved = ledger.after_mutation(ledger.recorded(obs).withColumn("ranges", F.expr("array(named_struct('start', 1L, 'stop', 2L), named_struct('start', 9L, 'stop', 12L))")), spark.createDataFrame([("s", "p", "n2", 5, 3)], "session string, path string, fingerprint string, edit_end long, delta long")).first()
    assert [tuple(x) for x in moved["ranges"]] == [(1, 2), (12, 15)] and (moved["fingerprint"], moved["total"]) == ("n2", 23)


def test_restore(spark):
    h = "a" * 64
    row = lambda path, kind="read", fp=h, complete=False, ranges=((1, 2),): ("s", path, kind, fp, complete, list(ranges), 9, "read", None, [])
    stored = spark.createDataFrame([row("ok"), row("../x"), row("k", kind="other"), row("f", fp="zz"), row("c", kind="search", complete=True), row("r", ranges=[(3, 2)]), row("gone")], EVIDENCE)
    now = spark.createDataFrame([(p, h) for p in ("ok", "../x", "k", "f", "c", "r")], "path string, fingerprint string")
    assert [r["path"] for r in ledger.restorable(stored, now).collect()] == ["ok"]
    assert ledger.of_session(stored, "t").count() == 0 and ledger.without_session(stored, "s", "ok").count() == 6


def test_command_files(spark):
    cases = {"cat a.py b.py": {"a.py", "b.py"}, "grep -n foo 'my file' | wc": {"my file"}, "grep -c foo a": set(), "rg --count x a": set(), "sed -n 1p a": {"a"}, "/usr/bin/CAT.exe a": {"a"}, "echo a; tail a\nless b": {"a", "b"}, "cat > a": {"a"}, "": set()}
    d = spark.createDataFrame(list(enumerate(cases)), "k int, command string")
    got = {}
    for r in ledger.inspected_files(d, ["k"]).collect():
        got.setdefault(r["k"], set()).add(r["path"])
    assert [got.get(i, set()) for i in range(len(cases))] == list(cases.values())


def test_logs(spark):
    text = "src/a.ts:12:3: hit\nsrc/a.ts-13-context\n--\n a.ts:99\n\x1b[1m  --> b.rs:5:1\x1b[0m\nother.ts:4:x\nError at fn (a.ts:30:2)\n"
    d = spark.createDataFrame([(1, text, ["src/a.ts", "src/b.rs"])], "k int, text string, candidates array<string>")
    got = {(r["path"], r["line"], r["hit"]) for r in ledger.parsed_log(d, ["k"]).collect()}
    assert got >= {("src/a.ts", 12, True), ("src/a.ts", 13, False), ("src/b.rs", 5, True), ("src/b.rs", 3, False), ("src/b.rs", 7, False), ("src/a.ts", 30, True), ("src/a.ts", 28, False)}
    assert not any(line == 4 and path == "src/a.ts" for path, line, _ in got)
    one = spark.createDataFrame([(1, "7:x\n8-y\n", ["q"])], "k int, text string, candidates array<string>")
    assert sorted((r["line"], r["hit"], r["said"]) for r in ledger.parsed_log(one, ["k"]).collect()) == [(7, True, "x"), (8, False, None)]


def test_paging(spark):
    src = "".join(f"l{i}\n" for i in range(1, 11))
    rows = [(1, "head -n 3 f", "l1\nl2\nl3\n"), (2, "tail -n 2 f", "l9\nl10"), (3, "sed -n '4,5p' f", "l4\nl5\n"), (4, "sed -n 4,5p f", "l4\nwrong"), (5, "head -n 99 f", src), (6, "cat f", src), (7, "sed -n 9,12p f", "l9")]
    d = spark.createDataFrame([(*r, src) for r in rows], "k int, command string, text string, source string")
    assert sorted(map(tuple, ledger.paged_lines(d, ["k"]).collect())) == [(1, 1, 3), (2, 9, 10), (3, 4, 5), (5, 1, 10)]


def test_anchor_edits(spark):
    text = "a\nb\nc\nd"
    marks = spark.createDataFrame([(text,)], "x string").select(line_hashes("x")).first()[0]
    files = spark.createDataFrame([(p, text) for p in "pqrst"], "path string, content string")
    schema = "path string, i int, pos string, end string, lines array<string>"
    e = spark.createDataFrame([("p", 0, f"2#{marks[1]}", None, ["B", "B2"]), ("p", 1, "4", None, []), ("q", 0, "1", "2", ["x"]), ("q", 1, "2", "3", ["y"]), ("r", 0, f"1#{'00' if marks[0] != '00' else '01'}", None, ["x"]), ("s", 0, "3", "9", []), ("t", 0, "zz", None, [])], schema)
    got = {r["path"]: (r["ok"], r["error"], r["new_content"]) for r in edits.apply_anchors(e, files).collect()}
    assert got["p"] == (True, None, "a\nB\nB2\nc") and got["q"][:2] == (False, "edits overlap") and got["q"][2] == text
    assert got["r"][1].startswith("stale anchor at line 1") and got["s"][1] == "end is out of bounds" and got["t"][1] == "bad anchor"


def test_verification(spark):
    e = spark.createDataFrame([(1, True, "clean", None, None, "a.py"), (2, True, "failed", "bad  token", None, None), (3, False, "not run", "why", "because", None), (4, True, "clean", None, None, None), (5, True, "not run", None, None, None), (6, True, "timeout", None, None, None)], "k int, applied boolean, syntax string, message string, reason string, target string")
    f = spark.createDataFrame([(4, i, "warning" if i else None, i, None, f"m{i}") for i in range(7)], "k int, seq int, severity string, line int, col int, message string")
    got = {r["k"]: (r["state"], r["text"]) for r in edits.verification(e, f, ["k"]).collect()}
    assert got[1] == ("clean", "Successfully applied edit to a.py.") and got[2] == ("syntax failed", "Edit: Applied\nSyntax Error:\n  - bad token")
    assert got[3] == ("not applied", "Edit: Not applied\nReason:\n  - because\n  - why") and got[5][0] == "unchecked" and got[6][0] == "syntax uncertain"
    assert got[4][0] == "errors" and got[4][1].startswith("Edit: Applied\nDiagnostics (errors):\n  - [0] m0\n") and got[4][1].endswith("\n  - +2 more")
    assert {(r["severity"], r["n"]) for r in edits.diagnostics_by_severity(f, ["k"]).collect()} == {("error", 1), ("warning", 6)}


@pytest.mark.parametrize(("text", "want"), [('{"a": 1}', '{"a": 1}'), ('{"a": [1, 2,', '{"a": [1, 2\n]\n}'), ('{"a": "x{"', '{"a": "x{"\n}'), ("{a", None), ("nonsense", None), ('{"a": NaN}', None)])
def test_heal(text, want):
    assert edits.heal_json(text) == want


def test_delimiters(spark):
    assert edits.missing_delimiters("f(a, [1, { '}' // )\n /* ] */ \"\\\"}\"") == ["}", "]", ")"]
    assert edits.structure_error("f(a]\n") == "line 1: unexpected ]" and edits.structure_error("a\n{") == "line 2: { is not closed" and edits.structure_error("{}") is None
    d = spark.createDataFrame([("(", '{"a"'), (None, None)], "x string, j string")
    assert [tuple(r) for r in d.select(edits.unclosed("x"), edits.structure("x"), edits.healed_json("j")).collect()] == [([")"], "line 1: ( is not closed", None), (None, None, None)]


def test_shell_output_becomes_evidence(spark):
    body = "\n".join(f"line {i}" for i in range(1, 21))
    files = spark.createDataFrame([("src/a.py", body, "f" * 64), ("src/b.py", body, "e" * 64)], "path string, content string, fingerprint string")
    outputs = spark.createDataFrame(
        [("s", 1, "grep -n line a.py b.py", "src/a.py:3:line 3\nsrc/a.py:4:line 4\nb.py-7-line 7"), ("s", 2, "sed -n '5,6p' src/a.py", "line 5\nline 6"), ("s", 3, "sed -n '5,6p' src/a.py", "not what stands there"), ("s", 4, "ls", "a.py:1:x")],
        "session string, seq long, command string, text string",
    )
    seen = {(r["seq"], r["path"]): r for r in ledger.shell_observations(outputs, files).collect()}
    assert set(seen) == {(1, "src/a.py"), (1, "src/b.py"), (2, "src/a.py")}
    assert [tuple(x) for x in seen[1, "src/a.py"]["ranges"]] == [(3, 4)] and [tuple(x) for x in seen[1, "src/a.py"]["hits"]] == [(3, "line 3"), (4, "line 4")]
    assert seen[1, "src/b.py"]["kind"] == "read" and [tuple(x) for x in seen[2, "src/a.py"]["ranges"]] == [(5, 6)]
    got = {r["path"]: r for r in ledger.recorded(ledger.shell_observations(outputs, files)).collect()}
    assert [tuple(x) for x in got["src/a.py"]["ranges"]] == [(3, 6)] and got["src/a.py"]["provenance"] == "shell" and got["src/a.py"]["total"] == 20


def test_state_is_stored_and_restored(spark, tmp_path):
    line = lambda path, print_, kind="read": ("s", path, kind, print_, False, [(1, 2)], 9, "read", None, [(1, "x")])
    schema = "session string, path string, kind string, fingerprint string, complete boolean, ranges array<struct<start: bigint, stop: bigint>>, total bigint, provenance string, query string, hits array<struct<line: bigint, text: string>>"
    rows = [line("a.py", "f" * 64), line("b.py", "e" * 64), line("../c.py", "f" * 64), line("d.py", "short"), line("e.py", "f" * 64, "odd")]
    every = spark.createDataFrame(rows, schema)
    ledger.save_state(every, f"file://{tmp_path}", 1)
    current = spark.createDataFrame([("a.py", "f" * 64), ("b.py", "0" * 64)], "path string, fingerprint string")
    got = ledger.load_state(spark, f"file://{tmp_path}", 1, current, "s").collect()
    assert [r["path"] for r in got] == ["a.py"] and got[0]["session"] == "s" and tuple(got[0]["ranges"][0]) == (1, 2)
    assert ledger.load_state(spark, f"file://{tmp_path}", 1, current, "t").collect() == []
    assert ledger.storable(every, most=1).count() == 1 and ledger.storable(every, most_bytes=10).count() == 0

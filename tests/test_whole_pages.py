"""Queries of pages take whole pages."""

import random

from tessera.operators import chunking
from tessera.plans import catalog

DRAW = random.Random(7)


def brute(lines):
    """Ends by a scan from each line on."""
    out = []
    for i in range(len(lines)):
        depth, opened, end = 0, False, len(lines)
        for j in range(i, len(lines)):
            depth, opened = depth + lines[j].count("{") - lines[j].count("}"), opened or "{" in lines[j]
            if opened and depth <= 0:
                end = j + 1
                break
        out.append(end)
    return out


def test_ends_of_braces_match_brute_force():
    for _ in range(500):
        lines = ["".join(DRAW.choice("{{}}a ") for _ in range(DRAW.randrange(4))) for _ in range(DRAW.randrange(1, 40))]
        assert chunking.ends_of_braces(lines) == brute(lines)


def brute_indent(lines):
    """Ends by a scan from each line on."""
    depth = lambda x: len(x) - len(x.lstrip())
    out = []
    for i, x in enumerate(lines):
        solid = [j for j in range(i + 1, len(lines)) if lines[j].strip() and not lines[j].strip().startswith("#")]
        out.append(next((j for j in solid if depth(lines[j]) <= depth(x)), (solid[-1] if solid else len(lines) - 1) + 1))
    return out


def test_ends_of_indents_match_brute_force():
    for _ in range(500):
        lines = [DRAW.choice(["", " ", "  ", "   "]) + DRAW.choice(["", "a", "b c", "# no", "\t", "d"]) for _ in range(DRAW.randrange(1, 40))]
        assert chunking.ends_of_indents(lines) == brute_indent(lines)


def test_brace_span_goes_beyond_sixty_lines(spark, tmp_path):
    html = ["<a" + "\nx}" * 3 + "<b\n" * n + "}\n" * (n + 5) for n in (1, 30, 100)] + ["", "plain\n" * 70, "<p" + "\nx" * 90 + "}\nend"]
    rows = [(i, h) for i, h in enumerate(html)] + [(10, None)]
    spark.createDataFrame(rows, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {(r["page_id"], r["line"]): r["stop"] for r in catalog.QUERIES["brace_span"](spark, str(tmp_path)).collect()}
    want = {(i, at + 1): stop for i, h in enumerate(html) for at, stop in enumerate(brute(h.replace("<", "{\n").split("\n")))}
    assert got == want
    assert got[5, 1] == 92

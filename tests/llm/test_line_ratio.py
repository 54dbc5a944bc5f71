"""Operator 6 on boilerplate below a tenth of a host's pages."""

import random

import pytest

from tessera.llm import line_dedup

DRAW = random.Random(13)
LETTERS = "abcdefghijklmnopqrstuvwxyz"
FOOTER = "All rights reserved by the owners of this site, see terms."
PASSAGE = " ".join(f"passage{i}" for i in range(50))


def prose(n):
    return " ".join("".join(DRAW.choice(LETTERS) for _ in range(6)) for _ in range(n))


@pytest.mark.parametrize(("most", "listed"), [(1000, 256), (1000, 0), (0, 0)])
def test_long_lines_go_at_lower_ratios(spark, most, listed):
    pages = [(i, "site", f"{prose(40)}\n{FOOTER if i < 35 else prose(9)}") for i in range(500)]  # a footer on 7 %
    pages += [(i, "hot", f"{prose(60)}\n{PASSAGE if i < 1030 else prose(50)}\n{'Yes.' if i < 1050 else 'No.' if i < 1090 else prose(3)}") for i in range(1000, 4000)]
    copy = "\n".join(prose(20) for _ in range(4))
    pages += [(i, "site", copy) for i in range(5000, 5030)]  # copies hold nothing but what others hold
    docs = spark.createDataFrame(pages, "doc_id long, source string, text string").repartition(3)
    got = {r["row"]["doc_id"]: r for r in line_dedup.line_dedup(docs, most_broadcast=most, most_listed=listed).collect()}
    assert len(got) == len(pages)
    for i, host, text in pages:
        want = [x for x in text.split("\n") if x not in (FOOTER, PASSAGE)]
        assert got[i]["text"] == "\n".join(want), (i, host)
        assert got[i]["n_dropped"] == text.count("\n") + 1 - len(want)


def test_hosts_of_urls(spark):
    urls = {"https://Site.example/a?b=http://x.y": "site.example", "http://u:p@h.example:80/": "h.example", "ftp+x://a.b#c": "a.b", "no url": None, "": None, None: None}
    got = spark.createDataFrame([(u,) for u in urls], "url string").select("url", line_dedup.host_of("url").alias("h")).collect()
    assert {r["url"]: r["h"] for r in got} == urls
    pages = [(i, f"https://{'one' if i % 2 else 'two'}.example/{i}", f"{prose(20)}\nMenu of one\n" + "x" * i if i % 2 else f"{prose(20)}\n{'Menu of one' if i == 2 else prose(4)}") for i in range(60)]
    names = "row long, url string, text string, `left` string, drop int"
    docs = spark.createDataFrame([(*p, "l", 3) for p in pages], names)
    for listed in (256, 0):
        rows = {r["row"]["row"]: r for r in line_dedup.line_dedup(docs, most_listed=listed).collect()}
        assert len(rows) == 60 and all(r["n_dropped"] == i % 2 for i, r in rows.items()) and rows[2]["text"].endswith("Menu of one")
        assert rows[3]["row"]["left"] == "l"

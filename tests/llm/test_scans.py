"""Operators 1 and 2 against plain Python."""

import hashlib
import random
import re

import numpy as np
import pytest

from tessera.llm import decontaminate, licenses
from tessera.llm.common import shingle_hashes, shingle_pairs, token_words, word_hashes

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


TEXTS = [
    "Licensed under the Apache License, Version 2.0.",
    "CC BY-NC 4.0 cc by cc by; cc  BY",
    None,
    "",
    "Free under the MIT License. GNU General Public License v3, gnu general public license",
    "cc bye accby the gnu general-public\nlicense",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
    "Permission is hereby granted to nobody",
    "é cc by ü",
    "permission was hereby granted free x charge to every person obtaining no copy of this software",
    "permission is hereby granted free x charge to every person obtaining a copy of this software",
    "Redistribution and use, in source and binary forms, with or without modification",
    "redistribution and use in source or binary forms with or without modification are permitted",
    "word " * 30_000 + "mit license",
]


@pytest.mark.parametrize("extra", [False, True])
def test_license_places_match_plain_search(spark, extra):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(0, TEXTS[0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    lost = licenses.license_scan(spark.createDataFrame([(None, TEXTS[0])], "doc_id long, text string")).first()
    assert (lost["doc_id"], lost["base_labels"]) == (None, "apache")
    if extra:
        docs = docs.selectExpr("doc_id", "text", "1 AS hits", "2 AS words", "3 AS n_words")
    got = sorted(licenses.license_scan(docs).collect(), key=lambda r: r["doc_id"])
    assert len(got) == len(rows)
    base = {t.words: t.label for t in licenses.BASE}
    for r, (i, text) in zip(got, sorted(rows, key=lambda x: x[0]), strict=True):
        ws = words(text)
        places = [(s, label) for p, label in base.items() for s in range(len(ws)) if ws[s : s + len(p.split())] == p.split()]
        assert (r["doc_id"], r["n_words"], r["n_base"]) == (i, len(ws), len(places))
        assert (r["first_word"], r["last_word"]) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in places}))
        assert {*r["base_labels"].split(",")} - {""} <= {*r["labels"].split(",")} and 0 <= r["score"] <= 1
    labels = {r["doc_id"]: r["labels"] for r in got}
    assert [labels[i] for i in (6, 7, 9, 10, 11, 12)] == ["mit", "", "", "mit", "bsd", ""]


def test_a_phrase_of_common_words_alone_is_refused():
    with pytest.raises(ValueError, match="beside a licence word"):
        licenses.Index.of([licenses.Template("x", "x", "you may use it with this", ("use it with",))])


def test_license_scan_of_no_rows(spark):
    assert licenses.license_scan(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def brute(text, items, window=10):
    ws, hit, found = words(text), set(), set()
    for i, t in items:
        it = words(t)
        n = min(window, len(it))
        for s in range(len(it) - n + 1 if n else 0):
            for p in range(len(ws) - n + 1):
                if ws[p : p + n] == it[s : s + n]:
                    hit.update(range(p, p + n))
                    found.add(str(i))
    return len(ws), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("broadcast", [0, 1 << 20])
def test_decontamination_matches_brute_force(spark, broadcast):
    item = "a b c d e f g h i j k l"
    items = [(1, item), (2, "Short One"), (10, "x " * 15), (3, None), (4, ""), (None, "q r s"), (1, item), (5, "c d e f g h i j k l")]
    texts = [f"start {item.upper()} end", "short, one. short one", "x " * 40, None, "", "a b c d e f g h i", "b c d e f g h i j k", "q r s", "nothing here", ("pad " * 20_000) + item, " ".join(f"u{i} {item}" for i in range(40)), "short one q r s x x x x x x x x x x a"]
    rows = [(i, t, "old") for i, t in enumerate(texts)] + [(0, texts[0], "old")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.digest(decontaminate.decontaminate(docs, bench, most_bytes=broadcast)).collect()
    assert len(got) == len(rows)
    known = [(i, t) for i, t in items if i is not None]
    for r in got:
        assert tuple(r)[1:] == brute(texts[r["doc_id"]], known)


def test_decontamination_of_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r)[:4] for r in decontaminate.digest(decontaminate.decontaminate(docs, none)).collect()] == [(1, 2, 0, 0)]
    assert decontaminate.decontaminate(docs.limit(0), none).collect() == []


def test_decontamination_of_random_texts_and_many_windows(spark):
    """Short words, so that windows share most of their shingles; and 20,000 windows, by a fixed number of jobs."""
    draw = random.Random(4)
    items = [(i, " ".join(draw.choice("ab") for _ in range(draw.randrange(1, 16)))) for i in range(40)]
    texts = [" ".join(draw.choice("aabbc") for _ in range(draw.randrange(60))) for _ in range(60)] + ["a " * 300, None]
    rows = [(None if i == 5 else i, t, b"k") for i, t in enumerate(texts)]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string, key binary").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.digest(decontaminate.decontaminate(docs, bench)).collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted(((i, *brute(t, items)) for i, t, _ in rows), key=str)

    def jobs(n):
        many = spark.createDataFrame([(i, " ".join(f"w{draw.randrange(10**6)}" for _ in range(500))) for i in range(n)], "item_id long, text string").cache()
        target = many.where("item_id = 0").first()["text"]
        spark.sparkContext.setJobGroup(f"windows {n}", "count jobs")
        got = decontaminate.decontaminate(spark.createDataFrame([(1, "before " + target), (2, target[: len(target) // 2])], "doc_id long, text string"), many).collect()
        ran = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"windows {n}"))
        spark.sparkContext.setJobGroup("tests", "tests")
        assert [r["items"] for r in got] == [["0"], ["0"]]
        return ran

    assert abs(jobs(2) - jobs(40)) <= 6  # broadcasts and shuffles of a few rows may be planned as one job or two


def test_words_and_hashes():
    text = "  Foo bar\tFoo\n\né-1 x\x0b\x0cend " + "y" * 300 + " " + "y" * 301 + " eightlong eightlonG eightlon"
    (one, two), starts, ends = word_hashes(text.encode(), 2)
    parts = text.encode().split()
    assert [text.encode()[s:e] for s, e in zip(starts, ends, strict=True)] == parts
    for hashes in (one, two):
        assert hashes[0] == hashes[2] and len(set(hashes.tolist())) == len(set(parts))
    assert (word_hashes(text.encode())[0][0] == one).all() and (word_hashes(b"bar")[0][0] == one[1]).all()
    assert token_words("A-b É2\x00c".encode()) == ["a".encode(), b"b", "É2".encode(), b"c"]
    assert len(shingle_hashes(one, 3)) == len(one) - 2 and len(shingle_hashes(one[:2], 3)) == 1 and len(shingle_hashes(one[:0], 3)) == 0
    assert (shingle_pairs([one, two], 3)[:, 0] == shingle_hashes(one, 3)).all() and shingle_pairs([one[:0], two[:0]], 3).shape == (0, 2)
    clash = shingle_pairs([np.array([7, 7, 7], dtype=np.uint64), np.array([2, 1, 2], dtype=np.uint64)], 1)
    assert len(clash) == 2  # equal first halves are told apart


def test_words_of_every_length_differ():
    draw = random.Random(9)
    words = {bytes(draw.choice(b"ab") for _ in range(n)) for n in range(1, 90) for _ in range(40)}
    parts = word_hashes(b" ".join(sorted(words)), 2)[0]
    assert all(len(set(p.tolist())) == len(words) for p in parts)

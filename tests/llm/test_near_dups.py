"""Operator 4 against all pairs."""

import inspect
import random

import pytest

from tessera.llm import common, near_dups
from tessera.llm.components import connected_components


def brute(rows, k, similarity):
    sets = []
    for _, text in rows:
        ws = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for c in "\t\n\x0b\x0c\r":
            ws = ws.replace(c, " ")
        ws = [w for w in ws.split(" ") if w]
        sets.append({tuple(ws[i : i + k]) for i in range(max(1, len(ws) - k + 1))} if ws else set())
    part = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= similarity * (len(sets[i]) + len(sets[j]) - both) and part[i] != part[j]:
                a, b = part[i], part[j]
                part = [b if x == a else x for x in part]
    out = []
    for i, (doc_id, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if part[j] == part[i] and rows[j][0] is not None]
        out.append((doc_id, len(sets[i]), min(ids) if ids and sets[i] else doc_id))
    return sorted(out, key=str)


def corpus(seed):
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passage = [draw.choice(words) for _ in range(60)]
    texts = [None, "", " ", "one", "ONE", "one two", "one two three", "One Two Three"]
    for _ in range(12):
        base = [draw.choice(words) for _ in range(draw.choice([12, 40, 90, 200]))]
        if draw.random() < 0.5:
            base[5:5] = passage
        for _ in range(draw.choice([1, 2, 6, 14])):
            copy = list(base)
            for _ in range(draw.choice([0, 0, 1, 1, 2, 3])):
                copy[draw.randrange(len(copy))] = draw.choice(words)
            texts.append(" ".join(copy))
    ids = list(range(len(texts)))
    draw.shuffle(ids)
    return list(zip(ids, texts)) + [(ids[9], texts[9]), (None, texts[10]), (None, "alone here with no id"), (ids[11], "same id but other text entirely")]


@pytest.mark.parametrize(("k", "similarity", "run", "block"), [(3, 90, 64, 1_000_000), (5, 80, 3, 300), (3, 80, 1, 1_000_000), (3, 90, 2, 200)])
def test_components_match_all_pairs(spark, k, similarity, run, block):
    rows = corpus(similarity + run)
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, h string, n int").repartition(3)
    got = near_dups.near_duplicates(docs, k, similarity, run=run, block_shingles=block, most_broadcast=0 if run == 3 else 1000).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows, k, similarity)


def test_no_rows_and_no_links(spark):
    docs = spark.createDataFrame([(1, "a b c d"), (2, "e f g h")], "doc_id long, text string")
    assert near_dups.near_duplicates(docs.limit(0)).collect() == []
    assert sorted(tuple(r) for r in near_dups.near_duplicates(docs, 3, 90).collect()) == [(1, 2, 1), (2, 2, 2)]


def test_keep_one(spark):
    text = " ".join(f"t{i}" for i in range(60))
    rows = [(3, text, "a"), (2, text + " x", "b"), (2, text + " x", "b"), (9, "other words", "c"), (9, "other words", "c"), (None, text, "d"), (5, None, "e"), (5, None, "e")]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, source string, drop int, twice int")
    assert near_dups.keep_one(docs).columns == docs.columns and near_dups.keep_one(docs.limit(0)).collect() == []
    got = sorted(tuple(r) for r in near_dups.keep_one(docs).select("source").collect())
    assert got == [("b",), ("c",), ("d",), ("e",), ("e",)]


def test_texts_that_share_an_id_stay_apart(spark):
    one, other = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(1, one), (1, other), (2, one + " x"), (3, other + " y"), (3, "alone")]
    got = near_dups.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(tuple(r) for r in got) == sorted([(1, one), (1, other), (3, "alone")])


def test_rows_of_one_id_meet_their_own_texts_only(spark):
    """600 rows of one id and 600 of none, in 200 families each: a join on ids would make 720,000 rows of them."""
    rows = [(i, " ".join(f"w{i}x{n}x{j}" for j in range(60)) + (" end" if copy else "")) for i in (7, None) for n in range(200) for copy in (0, 0, 1)]
    got = near_dups.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90).collect()
    assert sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"] or 0) for r in got) == sorted((i or 0, len(t.split()) - 2, i or 0) for i, t in rows)
    kept = near_dups.keep_one(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90).collect()
    assert sum(r["doc_id"] == 7 for r in kept) == 200 and sum(r["doc_id"] is None for r in kept) == 600


def test_words_made_to_collide_are_told_apart(spark):
    """Thue-Morse words and their complements are equal under any polynomial modulo a power of two."""
    bits = [bin(i).count("1") % 2 for i in range(2048)]
    word, complement = "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)
    rows = [(1, f"{word} x y z"), (2, f"{complement} x y z"), (3, word), (4, complement), (5, "long " * 300_000 + "end")]
    got = near_dups.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == [(1, 2, 1), (2, 2, 2), (3, 1, 3), (4, 1, 4), (5, 2, 5)]


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 160)] + [(200, 200), (7, 3), (101, 100)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}}


def test_shingles_that_many_share_make_no_cluster(spark, monkeypatch):
    """400 texts without links, of phrases that many of them share: a hundred and more hold the same prefix shingle."""
    draw = random.Random(5)
    phrases = [f"p{i} q{i} r{i}" for i in range(40)]
    rows = [(i, " ".join(f"{draw.choice(phrases)} u{i}x{j}" for j in range(draw.choice([20, 30, 60])))) for i in range(400)]
    rows += [(1000 + i, text + " more") for i, text in rows[:9]]
    seen = []
    plain = near_dups.dealt_out
    monkeypatch.setattr(near_dups, "dealt_out", lambda members, *rest: seen.append(plain(members, *rest).count()) or plain(members, *rest))
    monkeypatch.setattr(near_dups, "frequent_shingles", lambda *_: (near_dups.np.zeros(0, dtype="uint64"), near_dups.np.zeros(0, dtype="int64")))
    got = near_dups.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90, run=8).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows, 3, 90)
    assert seen[0] < 40, seen


def test_run_forest_connects_what_pairs_of_bitmaps_would():
    np, draw = near_dups.np, near_dups.np.random.default_rng(3)
    for similarity in (90, 80, 50):
        rows = []
        for _ in range(60):
            base = draw.integers(0, 1 << 62, int(draw.choice([1, 5, 60, 130, 700, 2000])), dtype=np.uint64)
            for _ in range(draw.integers(1, 4)):
                kept = base[draw.random(len(base)) < 0.97]
                if len(kept):
                    bits = np.frombuffer(near_dups.bitmap(kept, similarity), dtype=np.uint64)
                    loose = draw.integers(0, 1 << 62, len(bits), dtype=np.uint64) & draw.integers(0, 1 << 62, len(bits), dtype=np.uint64) if draw.random() < 0.3 else None
                    rows.append((len(kept), len(rows), bits.tobytes() if loose is None else (bits & ~loose).tobytes(), None if loose is None else loose.tobytes()))
        rows.sort(key=lambda r: r[:2])
        sizes = np.array([r[0] for r in rows])
        part = list(range(len(rows)))
        for i, (n, _, x, u) in enumerate(rows):
            for j, (m, _, y, v) in enumerate(rows[:i]):
                if 100 * m >= similarity * n and near_dups.differing(x, y, u, v) <= near_dups.may_differ(n, m, similarity):
                    part = [part[j] if z == part[i] else z for z in part]
        mine = list(range(len(rows)))
        links = near_dups.run_forest(np.arange(len(rows)), sizes, [r[2] for r in rows], [r[3] for r in rows], similarity)
        assert len(links) == len(rows) - len(set(part))
        for i, j in links:
            mine = [mine[j] if z == mine[i] else z for z in mine]
        assert all((part[i] == part[j]) == (mine[i] == mine[j]) for i in range(len(rows)) for j in range(i))


def test_little_is_broadcast_and_little_is_shuffled(spark):
    """Rows that may be broadcast stay far below the driver's memory; beyond them a map of keys passes few texts but theirs."""
    for f in (near_dups.near_duplicates, near_dups.keep_one):
        assert inspect.signature(f).parameters["most_broadcast"].default <= 100_000
    keys = spark.range(40_000).selectExpr("md5(cast(id as string)) AS key")
    bits = common.key_map(keys.limit(2000))
    wanted = keys.limit(2000).collect()
    passed = keys.unionByName(spark.sql("SELECT cast(NULL AS string) AS key")).where(common.may_hold("key", bits)).collect()
    assert {r["key"] for r in wanted} <= {r["key"] for r in passed} and len(passed) < 2000 + 38_000 // 20
    assert not common.key_map(keys.limit(0)).any()


def test_keep_one_is_the_same_without_broadcasts(spark):
    rows = [(i, t, n) for n, (i, t) in enumerate(corpus(7))] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int").repartition(3)
    one, other = (sorted(map(str, near_dups.keep_one(docs, 3, 90, most_broadcast=most).drop("n").collect())) for most in (0, 1000))
    assert one == other and len(one) < len(rows)

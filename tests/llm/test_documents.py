"""Operators 3, 6, 7, 8 and 9 against plain Python."""

import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tessera.llm import chat, line_dedup, quality_model, quality_rules, token_counts

SPACE = " \t\n\x0b\x0c\r"
DRAW = random.Random(3)
WORDS = ["alpha", "beta", "Gamma", "délta", "x", "***", "日本"]
TEXTS = [None, "", " \n\t ", "one two", "a b c a b c", "x x x x", "line one\nline one\n\n\nline one \n", "# * $ % & | < >", "é日 本 q", "p q r s p q r"] + [" ".join(DRAW.choice(WORDS) for _ in range(DRAW.randrange(5, 300))) for _ in range(60)] + ["long word " * 20_000]


def split(text):
    out, word = [], ""
    for c in (text or "") + " ":
        if c in SPACE:
            out += [word] * bool(word)
            word = ""
        else:
            word += c
    return out


def rules(text):
    ws, text = split(text), text or ""
    windows = Counter(tuple(ws[i : i + 3]) for i in range(len(ws) - 2))
    hit = {p for i in range(len(ws) - 2) if windows[tuple(ws[i : i + 3])] > 1 for p in range(i, i + 3)}
    lines = [x for x in text.split("\n") if split(x)]
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)


def test_rule_counts_match_plain(spark):
    rows = [(i, t, True) for i, t in enumerate(TEXTS)] + [(1, TEXTS[1], True), (None, "null id", True)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept boolean")
    labels = spark.createDataFrame([(20, 1), (21, 1), (None, 1), (22, None), (23, 0), (20, 1)], "doc_id long, quality int")
    got = quality_rules.quality_rules(docs, labels).collect()
    assert len(got) == len(rows)
    for r in got:
        assert tuple(r[c] for c in quality_rules.COUNTS) == rules(r["row"]["text"])
        n, *_, repeat = rules(r["row"]["text"])
        assert r["base_failed"] == (n < 50 or 100 * repeat > 50 * n)
        assert not (r["base_failed"] and r["kept"])
    assert quality_rules.quality_rules(docs.limit(0), labels).collect() == []
    bare = quality_rules.quality_rules(docs, labels.limit(0)).collect()
    assert all(r["kept"] != r["base_failed"] for r in bare)


def test_words_made_to_collide_are_no_repeats():
    bits = [bin(i).count("1") % 2 for i in range(2048)]
    word, other = ("".join(x[b] for b in bits).encode() for x in ("ab", "ba"))
    assert quality_rules.rule_counts(b" ".join([word, b"x", b"y", other, b"x", b"y"]))[4] == 0
    assert quality_rules.rule_counts(b" ".join([word, b"x", b"y", word, b"x", b"y"]))[4] == 6
    raw = DRAW.randbytes(3_000_000)
    counts = quality_rules.gram_counts(raw, 1 << 14)
    assert counts.sum() == len(raw) - 3 and (counts == np.bincount(quality_rules.grams(raw), minlength=1 << 14)).all()


def test_null_ids_are_never_trusted(spark):
    docs = spark.createDataFrame([(-1, "good words here " * 30), (None, "&&& *** $$$ " * 30), (None, "&&& " * 90)], "doc_id long, text string")
    labels = spark.createDataFrame([(-1, 1), (None, 1)], "doc_id long, quality int")
    got = {r["row"]["text"][:4]: r["score"] for r in quality_rules.quality_rules(docs, labels).collect()}
    assert got["good"] > 0 > got["&&& "]


def test_long_words_are_counted_and_not_kept(spark):
    long = "ab" * 500_000
    path = public_tokenizers.path("word_bpe_49k.json")
    docs = spark.createDataFrame([(1, f"{long} a {long}"), (None, None), (1, "a")], "doc_id long, text string")
    got = {(r["doc_id"], r["n_words"]): r["n_tokens"] for r in token_counts.token_counts(docs, path).collect()}
    one = token_counts.Automaton(token_counts.byte_vocabulary(path)).count
    assert got == {(1, 3): 2 * one(long.encode()) + one(b"a"), (None, 0): 0, (1, 1): one(b"a")}
    assert token_counts.token_counts(docs.limit(0), path).collect() == []


def test_long_texts_are_pooled_in_little_memory():
    raw = b"some words of a text and then more " * 600_000  # 21 MB
    vectors = quality_model.Vectors.of(np.ones((quality_model.BUCKETS, quality_model.DIM)), np.arange(quality_model.BUCKETS))
    tracemalloc.start()
    got = vectors.pooled(raw)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 120 << 20
    assert np.allclose(got[:-2], vectors.pooled(raw[: 35 * 5000])[:-2], atol=1e-4)
    assert len(quality_model._rows(b"x" * (3 << 20))) >= 3 and len(quality_model._rows(b"")) == 0


def test_likelihood_ratio_matches_plain(spark):
    texts = ["the cat sat on the mat " * 20 + str(i) for i in range(5)] + ["### $$$ %%% &&& " * 20 + str(i) for i in range(5)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    buckets = 64
    hashed = lambda t: [int(np.uint32(int.from_bytes(t.encode()[i : i + 4], "little")) * np.uint64(0x9E3779B1) % (1 << 32)) >> 26 for i in range(len(t.encode()) - 3)]
    raw, good = Counter(b for t in texts for b in hashed(t)), Counter(b for t in texts[:3] for b in hashed(t))
    p = lambda c, b: (c[b] + 1) / (sum(c.values()) + buckets)
    want = [float(np.mean([np.log(p(good, b)) - np.log(p(raw, b)) for b in hashed(t)])) for t in texts]
    labels = spark.createDataFrame([(i, 1) for i in range(3)], "doc_id long, quality int")
    got = {r["row"]["doc_id"]: r["score"] for r in quality_rules.quality_rules(docs, labels, buckets=buckets).collect()}
    assert np.allclose([got[i] for i in range(10)], want)


def test_token_counts_match_naive_longest_match(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    vocabulary = token_counts.byte_vocabulary(path)

    def naive(word, words=vocabulary):
        n = at = 0
        while at < len(word):
            end = next((e for e in range(len(word), at, -1) if word[at:e] in words), None)
            if end is None:
                return 1
            n, at = n + 1, end
        return n

    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(TEXTS)], "doc_id long, text string, n_words int")
    for r in token_counts.token_counts(docs, path).collect():
        text = re.sub("[A-Z]", lambda m: m[0].lower(), TEXTS[r["doc_id"]] or "")
        ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
        marks = len(re.findall(r"[!-/:-@\[-`{-~]", text))
        known = {w: naive(w.encode()) for w in set(ws)}
        assert (r["n_words"], r["n_punctuation"], r["n_tokens"]) == (len(ws), marks, sum(known[w] for w in ws) + marks)
    small = {b"a", b"ab", b"abcd", b"c", b"bc", b"d"}
    machine = token_counts.Automaton(small)
    for _ in range(2000):
        word = bytes(DRAW.choice(b"abcde") for _ in range(DRAW.randrange(1, 12)))
        assert machine.count(word) == naive(word, small)


@pytest.mark.parametrize("most", [1000, 0])
def test_line_dedup_matches_plain(spark, most):
    pages = [(i, "h", f"menu\nbody {i}\n\nmenu \nfoot") for i in range(20)] + [(30, "h", None), (31, "h", ""), (32, None, "menu\nx"), (33, None, "menu"), (34, "few", "menu"), (0, "h", "menu\nbody 0\n\nmenu \nfoot"), (40, "h", "only body\n" * 5000)]
    docs = spark.createDataFrame(pages, "doc_id long, source string, text string")
    got = line_dedup.line_dedup(docs, max_ratio=0.5, min_pages=3, most_broadcast=most).collect()
    assert len(got) == len(pages)
    key = lambda x: x.rstrip(" \t\r\x0b\x0c")
    for r in got:
        host, text = r["row"]["source"], r["row"]["text"]
        mine = [t for _, h, t in pages if h == host]
        if text is None:
            assert (r["text"], r["n_lines"], r["n_dropped"]) == (None, 0, 0)
            continue
        bad = {k for k in {key(x) for x in text.split("\n")} - {""} if (n := sum(k in {key(x) for x in t.split("\n")} for t in mine if t is not None)) >= 3 and n > 0.5 * len(mine)}
        left = [x for x in text.split("\n") if key(x) not in bad]
        assert (r["text"], r["n_lines"], r["n_dropped"]) == ("\n".join(left), len(text.split("\n")), len(text.split("\n")) - len(left))
    assert line_dedup.line_dedup(docs.limit(0)).collect() == []


def test_chat_collapse_matches_plain(spark):
    logs = {1: "ab", 2: "abc", 3: "abc", 4: "abcd", 5: "abx", 6: "b", 7: "abx", 8: "a" * 40}
    rows = [(c, i, "user" if i % 2 == 0 else "assistant", x) for c, s in logs.items() for i, x in enumerate(s)]
    rows += [rows[0], (None, 0, "user", "lost"), (9, 0, None, None), (10, None, "user", "<|user|>")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("whole", F.lit(1))
    got = {r["conv_id"]: r for r in chat.chat_format(table).collect()}
    want = {c for c, s in logs.items() if not any(len(t) > len(s) and t.startswith(s) for t in logs.values()) and not any(t == s and d < c for d, t in logs.items())}
    assert set(got) == want | {9, 10}
    assert got[5]["n_copies"] == 2 and got[4]["n_turns"] == 4
    assert got[4]["text"].startswith("<|user|>\na\n<|end|>\n<|assistant|>\nb\n<|end|>\n") and got[9]["text"] == "<|unknown|>\n\n<|end|>\n"
    assert got[10]["text"].count("<|user|>") == 1
    assert chat.chat_format(table.limit(0)).collect() == []


def test_quality_model_on_held_out_rows(spark):
    draw = random.Random(5)
    good, bad = ["the", "house", "is", "near", "a", "river", "and", "trees"], ["BUY", "now!!", "$$$", "free", "###", "click"]
    texts = [" ".join(draw.choice(good if i % 2 else bad) for _ in range(60)) for i in range(400)] + [None, ""]
    docs = spark.createDataFrame([(i, t, 0.0) for i, t in enumerate(texts)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)] + [(None, 1), (3, None)], "doc_id long, quality int")
    got = quality_model.quality_model(docs, labels).collect()
    assert len(got) == len(texts)
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
    out = [r for r in got if r["held_out"] and r["doc_id"] < 400]
    assert np.mean([r["predicted"] == r["doc_id"] % 2 for r in out]) > 0.95
    flipped = labels.selectExpr("doc_id", "IF(crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 4 = 2, 1 - quality, quality) AS quality")
    again = {r["doc_id"]: r["score"] for r in quality_model.quality_model(docs, flipped).collect()}
    assert all(again[r["doc_id"]] == r["score"] for r in got)  # held-out labels don't matter
    assert quality_model.quality_model(docs.limit(0), labels).collect() == []
    assert len(quality_model.quality_model(docs, labels.limit(0)).collect()) == len(texts)

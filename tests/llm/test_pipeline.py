"""The pipeline's stages against brute force on a small fixture."""

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from test_documents import rules
from test_near_dups import brute as components
from test_scans import brute as contaminated

import corpus_pipeline
from tessera.llm.encode import PieceEncoder

DRAW = random.Random(11)
WORDS = [a + b for a in ("ka", "lo", "mi", "nu", "re") for b in ("ta", "so", "vi", "zen", "dor", "pla")]


def prose(n):
    return " ".join(DRAW.choice(WORDS) for _ in range(n))


ITEM = prose(15)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    docs = [(i, f"Menu of the site\n{prose(70)}.\n{prose(60)}.", "en", f"src{i % 2}") for i in range(30)]
    docs += [(40, docs[3][1] + " once more", "en", "src0"), (41, docs[4][1], "en", "src1"), (42, f"{prose(80)} {ITEM} {prose(20)}", "en", "src3")]
    docs += [(50, "too short", "en", "src1"), (51, "### $$$ %%% " * 60, "en", "src1"), (52, None, None, None), (53, " ".join(f"&&&{i} ***" for i in range(90)), "en", "src0"), (54, prose(3000), "en", None)]
    spark.createDataFrame([(i, t, x, s, len(t or "")) for i, t, x, s in docs], "doc_id long, text string, lang string, source string, n_chars long").repartition(2).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i < 30), 0) for i in range(54)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, prose(4))], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def stage_by_stage(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        rows = stage(spark, docs, folder)
        rows.write.mode("overwrite").parquet(f"{folder}/out/{name}")
        docs = spark.read.parquet(f"{folder}/out/{name}")
        yield name, before, docs


def llr(texts, trusted):
    """Mean log ratio of hashed byte 4-grams, and the threshold, in plain Python."""
    hashed = {i: [(int.from_bytes(b[j : j + 4], "little") * 0x9E3779B1 % (1 << 32)) >> 18 for j in range(len(b) - 3)] for i, t in texts.items() for b in [(t or "").encode()]}
    raw, good = Counter(x for v in hashed.values() for x in v), Counter(x for i, v in hashed.items() if i in trusted for x in v)
    size = 1 << 14
    ratio = lambda x: np.log((good[x] + 1) / (sum(good.values()) + size)) - np.log((raw[x] + 1) / (sum(raw.values()) + size))
    known = {x: ratio(x) for x in raw}
    score = {i: float(np.mean([known[x] for x in v])) if v else 0.0 for i, v in hashed.items()}
    return score, float(np.percentile([score[i] for i in trusted], 0.5)) - 0.02


def test_stages_match_brute_force(spark, tables):
    columns = spark.read.parquet(f"{tables}/documents.parquet").columns
    pack = PieceEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    for name, before, after in stage_by_stage(spark, tables):
        old = {r["doc_id"]: r for r in before.collect()}
        new = {r["doc_id"]: r for r in after.collect()} if name != "packing" else {}
        texts = {i: r["text"] for i, r in old.items()}
        if name != "packing":
            assert after.columns == columns
        if name == "quality_rules":
            score, threshold = llr(texts, set(range(30)))
            failed = {i for i, t in texts.items() if rules(t)[0] < 50 or 2 * rules(t)[4] > rules(t)[0]}
            assert set(new) == {i for i in texts if i not in failed and score[i] >= threshold}
            assert {0, 29, 42, 54} <= set(new) and not {50, 51, 52, 53} & set(new)
        elif name == "line_dedup":
            hosts = Counter(r["source"] for r in old.values())
            seen = Counter((r["source"], x) for r in old.values() for x in set(r["text"].split("\n")))
            for i, r in old.items():
                left = [x for x in r["text"].split("\n") if not (seen[r["source"], x] >= 5 and seen[r["source"], x] > 0.1 * hosts[r["source"]])]
                assert (new[i]["text"], new[i]["n_chars"]) == ("\n".join(left), len("\n".join(left)))
            assert "Menu" not in new[0]["text"]
        elif name == "ngram_jaccard_join":
            assert set(new) == {i for i, _, c in components(list(texts.items()), 5, 80) if i == c}
            assert not {40, 41} & set(new)
        elif name == "decontamination":
            items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{tables}/benchmark.parquet").collect()]
            assert set(new) == {i for i, t in texts.items() if not contaminated(t, items)[4]}
            assert 42 in old and 42 not in new
        else:
            pieces, used = after.collect(), Counter()
            for i, t in texts.items():
                ids = np.append(np.frombuffer(pack.whole([t])[0], dtype="<u4"), np.uint32(1)).astype("<u4")
                mine = sorted((r["start"], r["length"], r["ids_crc32"]) for r in pieces if r["doc_id"] == i)
                assert [(s, n) for s, n, _ in mine] == [(s, min(2048, len(ids) - s)) for s in range(0, len(ids), 2048)]
                assert all(zlib.crc32(ids[s : s + n].tobytes()) == c for s, n, c in mine)
            for r in pieces:
                used[r["sequence_id"]] += r["length"]
            assert max(used.values()) <= 2048 and sum(v < 1024 for v in used.values()) <= 1


def test_run_gives_the_last_stage(spark, tables):
    *_, (_, _, last) = stage_by_stage(spark, tables)
    assert sorted(map(tuple, corpus_pipeline.run(spark, tables).collect())) == sorted(map(tuple, last.collect()))


def test_odd_rows_pass_every_stage(spark, tmp_path):
    """Null ids and texts, repeated rows and ids, a very long text, and columns named like those of the stages."""
    text = f"{prose(70)}.\n{prose(60)}."
    rows = [(1, text, "a"), (1, text, "a"), (None, text, "a"), (None, None, None), (2, "", "a"), (3, prose(100), None), (3, prose(100), "b"), (4, f"{prose(3000)}\n{prose(5)}", "b"), (5, f"{prose(80)} {ITEM}", "b")]
    columns = "doc_id long, text string, source string"
    docs = spark.createDataFrame(rows, columns).selectExpr("*", "CAST(NULL AS STRING) AS lang", "1L AS n_chars", "2 AS row", "3 AS kept", "4 AS key", "5 AS spans", "6 AS host", "7 AS `component`", "8 AS length")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1), (3, 1), (4, 1), (5, 1), (None, 1), (6, None)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (None, "x"), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left = {}
    for name, before, after in stage_by_stage(spark, str(tmp_path)):
        if name != "packing":
            assert after.columns == docs.columns
            left[name] = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in after.collect())
    rest = [(False, 1), (False, 3), (False, 3), (False, 4), (True, 0)]
    assert left["quality_rules"] == left["line_dedup"] == sorted([*rest, (False, 1), (False, 5)])
    assert left["ngram_jaccard_join"] == sorted([*rest, (False, 5)]) and left["decontamination"] == rest
    assert {r["doc_id"] for r in after.collect()} == {1, 3, 4, None}


def test_an_empty_table_passes_every_stage(spark, tables, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{tables}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []

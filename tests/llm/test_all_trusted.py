"""Operator 7 with more trusted documents than a sample would hold."""

import random

import numpy as np

from tessera.llm import quality_rules

DRAW = random.Random(17)
WORDS = ["".join(DRAW.choice("abcdefgh") for _ in range(3)) for _ in range(300)]
N = 24_000


def test_counts_and_threshold_take_all_trusted_documents(spark):
    texts = [" ".join(DRAW.choice(WORDS[: 100 + i % 200]) for _ in range(52)) for i in range(N + 500)]
    texts += [texts[0]] * 300 + ["&&& *** ### $$$ " + t for t in texts[-200:]]
    rows = list(enumerate(texts)) + [(None, texts[1]), (None, "&&& ***")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    good = set(range(N)) | set(range(N + 500, N + 800))
    labels = spark.createDataFrame([(i, int(i in good)) for i in range(len(texts))] + [(None, 1), (0, 1)], "doc_id long, quality int")
    hashed = [quality_rules.grams(t.encode()) for _, t in rows]
    size = quality_rules.BUCKETS
    raw = np.bincount(np.concatenate(hashed), minlength=size) + 1
    trusted = np.bincount(np.concatenate([hashed[i] for i in sorted(good)]), minlength=size) + 1
    ratio = np.log(trusted / trusted.sum()) - np.log(raw / raw.sum())
    want = np.array([ratio[h].mean() for h in hashed])
    threshold = np.percentile(want[sorted(good)], 0.5)
    got = quality_rules.quality_rules(docs, labels, slack=0.0).collect()
    assert len(got) == len(rows)
    for r in got:
        if (i := r["row"]["doc_id"]) is not None:
            assert abs(r["score"] - want[i]) < 1e-12
            assert abs(want[i] - threshold) < 1e-12 or r["kept"] == (not r["base_failed"] and want[i] >= threshold)
    assert 0 < sum(not r["kept"] for r in got if r["row"]["doc_id"] in good and not r["base_failed"]) < 0.01 * N


def test_percentile_matches_numpy(spark):
    for values in ([1.0], [2.0] * 5000 + [1.0], [DRAW.gauss(0, 1) for _ in range(9000)], [1e9] + [DRAW.random() for _ in range(9000)]):
        for share in (0.0, 0.005, 0.5, 1.0):
            got = quality_rules.percentile(spark.createDataFrame([(x,) for x in values], "s double"), share)
            assert np.isclose(got, np.percentile(values, 100 * share), rtol=1e-12)
    assert quality_rules.percentile(spark.createDataFrame([], "s double"), 0.5) is None

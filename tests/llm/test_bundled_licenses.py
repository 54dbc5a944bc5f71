"""Operator 1 on texts that hold many licences."""

from tessera.llm import licenses


def test_every_licence_of_a_bundle_is_found(spark):
    own = licenses.OWN
    bundle = ".\n\n".join(t.words for t in own)
    frequent = next(t for t in own if t.name == "mit-text").words  # its words stand in most texts, so any others are rarer
    mixed = frequent + " nc sa lesser mozilla unencumbered affero domain binary forms code"
    rows = [(0, bundle), (1, mixed)] + [(i, frequent) for i in range(2, 40)]
    got = {r["doc_id"]: r for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(got[0]["labels"].split(",")) == {t.label for t in own} | set(got[0]["base_labels"].split(","))
    assert got[1]["labels"] == "mit" and got[39]["labels"] == "mit"

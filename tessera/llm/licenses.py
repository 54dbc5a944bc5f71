"""Operator 1: license scans, with DataFrame functions only.

A positional rare-token index. The licence words of a text and their positions form its postings; how many texts hold
each licence word gives its rarity (IDF). The rarest word of a template's mandatory phrases is its anchor: a text without
it can't hold the phrases, so only texts that hold it are looked at. Postings of the words of a phrase, each shifted by its
place in the phrase, are intersected, which leaves the exact starts of the phrase. A template of one's own is accepted if
all of its mandatory phrases stand in the text, word for word, and the IDF-weighted share of its words that lie on one
diagonal (position in text minus position in template) is at least ``min_share``.

Common words of the phrases are indexed only where they stand beside a licence word, as every phrase has them.

Everything after the scan is a projection of one row: nothing is shuffled but one count for each licence word.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, TOKEN_WORD, UPPER, materialise


@dataclass(frozen=True)
class Template:
    """``words``: the licence sentence, lower case. ``mandatory``: phrases of it that must stand in the text."""

    name: str
    label: str
    words: str
    mandatory: tuple[str, ...]
    base: bool = False


# The base phrases and their labels.
BASE = (
    Template("gpl", "gpl", "gnu general public license", ("gnu general public license",), True),
    Template("apache", "apache", "apache license", ("apache license",), True),
    Template("cc-by", "cc-by", "cc by", ("cc by",), True),
    Template("mit", "mit", "mit license", ("mit license",), True),
)
OWN = (
    Template("agpl", "agpl", "gnu affero general public license", ("gnu affero general",)),
    Template("apache-2.0", "apache-2.0", "licensed under the apache license version 2 0", ("apache license version",)),
    Template("bsd", "bsd", "redistribution and use in source and binary forms with or without modification are permitted", ("source and binary forms", "without modification")),
    Template("cc-by-nc", "cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    Template("cc-by-sa", "cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    Template("gpl-text", "gpl", "free software you can redistribute it and modify it under the terms of the gnu general public license as published by the free software foundation", ("free software foundation", "gnu general")),
    Template("isc", "isc", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted", ("modify and distribute this software",)),
    Template("lgpl", "lgpl", "gnu lesser general public license", ("gnu lesser general",)),
    Template("mit-text", "mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", ("permission is hereby granted", "obtaining a copy")),
    Template("mpl", "mpl", "this source code form is subject to the terms of the mozilla public license", ("mozilla public license",)),
    Template("unlicense", "unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software", "public domain")),
)
#: Words that say nothing about licences. They have no share in a template; in a phrase they must stand like any other.
UNINDEXED = frozenset("a and any are as for in into is it of or that the this to use with you".split())


@dataclass(frozen=True)
class Index:
    """The templates' side of the index: licence words, the common words of phrases, and the places of both."""

    templates: tuple[Template, ...]
    vocabulary: tuple[str, ...] = field(default=())
    beside: tuple[str, ...] = field(default=())

    @staticmethod
    def of(templates: Sequence[Template]) -> Index:
        phrases = [p.split() for t in templates for p in t.mandatory]
        for p in phrases:
            for i, w in enumerate(p):
                if w in UNINDEXED and UNINDEXED.issuperset([*p[max(0, i - 1) : i], *p[i + 1 : i + 2]]):
                    raise ValueError(f"{' '.join(p)}: {w} must stand beside a licence word")
        words = {w for t in templates for w in t.words.split()} | {w for p in phrases for w in p}
        return Index(tuple(templates), tuple(sorted(words - UNINDEXED)), tuple(sorted(UNINDEXED.intersection(w for p in phrases for w in p))))

    @staticmethod
    def places(text: str) -> list[tuple[str, int]]:
        """Licence words of a template, with their places."""
        return [(w, i) for i, w in enumerate(text.split()) if w not in UNINDEXED]


def postings(docs: DataFrame, index: Index, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words and hits: the places (p, w) of the text's licence words, and of common words beside them."""
    lowered = F.translate(F.coalesce(F.col(text_col), F.lit("")), UPPER, LOWER)
    words = F.regexp_extract_all(lowered, F.lit(f"({TOKEN_WORD})"), F.lit(1))
    rows = docs.select(F.col(id_col).alias("doc_id"), words.alias("words"))
    placed = F.transform("words", lambda w, i: F.struct(i.cast("int").alias("p"), w.alias("w")))
    held = rows.select("doc_id", F.size("words").cast("long").alias("n_words"), F.filter(placed, lambda h: h["w"].isin(*index.vocabulary, *index.beside)).alias("hits"))
    if not index.beside:
        return held
    common = lambda h: h["w"].isin(*index.beside)

    def next_to(h: Column, i: Column) -> Column:
        """Whether a licence word stands right before or after in the text; it is the neighbour in ``hits`` then."""
        near = lambda d: F.coalesce((F.get("hits", i + d)["p"] == h["p"] + d) & ~common(F.get("hits", i + d)), F.lit(False))
        return ~common(h) | near(-1) | near(1)

    return held.withColumn("hits", F.filter("hits", next_to))


def _positions(word: str, shift: int) -> Column:
    return F.transform(F.filter("hits", lambda h: h["w"] == word), lambda h: h["p"] - F.lit(shift))


def _holds(word: str) -> Column:
    return F.exists("hits", lambda h: h["w"] == word)


def _starts(phrase: str, anchor: str) -> Column:
    """Starts of a phrase: shifted postings of all of its words, intersected, the anchor's first."""
    places = sorted(((w, i) for i, w in enumerate(phrase.split())), key=lambda x: x[0] != anchor)
    both = reduce(F.array_intersect, [_positions(w, i) for w, i in places])
    return F.filter(both, lambda p: p >= 0)


def _share(places: list[tuple[str, int]], weight: dict[str, float]) -> Column:
    """The largest weight of template words on one diagonal, as a share of the template's weight.

    The diagonals are sorted and summed run by run: linear in the text's licence words, however often one repeats.
    """
    total = sum(weight[w] for w, _ in places)
    weighted = lambda w, i: F.transform(_positions(w, i), lambda d: F.struct(d.alias("d"), F.lit(weight[w]).alias("x")))
    on = F.flatten(F.array(*(weighted(w, i) for w, i in places)))
    start = F.struct(F.lit(None).cast("int").alias("d"), F.lit(0.0).alias("x"), F.lit(0.0).alias("best"))

    def step(a: Column, h: Column) -> Column:
        x = F.when(a["d"].eqNullSafe(h["d"]), a["x"]).otherwise(F.lit(0.0)) + h["x"]
        return F.struct(h["d"].alias("d"), x.alias("x"), F.greatest(a["best"], x).alias("best"))

    return F.aggregate(F.array_sort(on), start, step, lambda a: F.round(a["best"] / F.lit(total), 6))


def idf(found: DataFrame, vocabulary: Sequence[str]) -> tuple[int, dict[str, int]]:
    """Number of texts, and of texts that hold each licence word: as many rows as the templates have words."""
    held = F.filter(F.array_distinct(F.transform("hits", lambda h: h["w"])), lambda w: w.isin(*vocabulary))
    one = found.select(F.explode(F.concat(F.array(F.lit("")), held)).alias("w"))
    counts = {r["w"]: r["n"] for r in one.groupBy("w").agg(F.count("*").alias("n")).collect()}
    return counts.get("", 0), {w: counts.get(w, 0) for w in vocabulary}


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: Sequence[Template] = BASE + OWN, min_share: float = 0.6) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    A null or empty text has no words, no places (first_word and last_word null), empty labels and score 0. Repeated
    rows are scanned each on its own; a null id is kept, an id of any type. Ties in rarity go by the word. Other columns are
    ignored; an empty table gives no rows; a long text is one row of a task. The score is the largest share among accepted
    templates, 1 where a base phrase stands. A template of one's own needs a mandatory phrase.
    """
    index = Index.of(templates)
    found = materialise(postings(docs, index, id_col, text_col), "postings")
    n_docs, df = idf(found, index.vocabulary)
    weight = {w: math.log((n_docs + 1) / (n + 1)) + 1 for w, n in df.items()}
    rare = sorted(index.vocabulary, key=lambda w: (df[w], w))
    rank = {w: i for i, w in enumerate(rare)}
    held = found
    none, columns, labels, places = F.array().cast("array<int>"), [], [], []
    for i, t in enumerate(index.templates):
        anchor = min((w for p in t.mandatory for w, _ in Index.places(p)), key=rank.__getitem__)
        if t.base:
            held = held.withColumn(f"s{i}", F.when(_holds(anchor), _starts(t.words, anchor)).otherwise(none))
            places.append(F.col(f"s{i}"))
            columns.append(F.when(F.size(f"s{i}") > 0, F.lit(1.0)).otherwise(F.lit(0.0)))
            labels.append(F.when(F.size(f"s{i}") > 0, F.lit(t.label)))
            continue
        key = [min((w for w, _ in Index.places(p)), key=rank.__getitem__) for p in t.mandatory]
        verified = reduce(Column.__and__, [F.size(_starts(p, a)) > 0 for p, a in zip(t.mandatory, key, strict=True)])
        share = F.when(_holds(anchor), F.when(verified, _share(Index.places(t.words), weight))).otherwise(F.lit(None).cast("double"))
        held = held.withColumn(f"s{i}", share)
        columns.append(F.when(F.col(f"s{i}") >= min_share, F.col(f"s{i}")).otherwise(F.lit(0.0)))
        labels.append(F.when(F.col(f"s{i}") >= min_share, F.lit(t.label)))
    n_base = len([t for t in index.templates if t.base])
    starts = F.flatten(F.array(*places)) if places else none
    joined = lambda xs: F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.array(*xs)))), ",") if xs else F.lit("")
    return held.withColumn("starts", starts).select(
        "doc_id", "n_words", F.size("starts").cast("long").alias("n_base"),
        F.array_min("starts").cast("long").alias("first_word"), F.array_max("starts").cast("long").alias("last_word"),
        joined([x for x, t in zip(labels, index.templates, strict=True) if t.base]).alias("base_labels"), joined(labels).alias("labels"),
        (F.greatest(F.lit(0.0), *columns) if len(columns) else F.lit(0.0)).alias("score"),
    )

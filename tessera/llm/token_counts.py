"""Operator 3: how many word pieces greedy longest-match cuts a text into, without building the pieces.

The vocabulary is a trie. A node's failure link leads to where matching goes on when no child fits, and the number of
pieces that are given off on the way is kept with it. So a word costs one step a byte, whatever the lengths of pieces.
"""

from __future__ import annotations

import json
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER_TABLE, frugal, text_bytes, token_words

#: All bytes but ASCII punctuation: what is deleted before punctuation is counted.
_NOT_PUNCTUATION = bytes(b for b in range(256) if not (0x21 <= b <= 0x7E and not chr(b).isalnum()))


def byte_vocabulary(path: str, end_mark: str = "</w>") -> set[bytes]:
    """Pieces of a byte-level vocabulary file as bytes; the mark of a word's end is taken off."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in printable]
    byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]["vocab"]
    out = set()
    for piece in model:
        chars = piece.removesuffix(end_mark)
        if chars and all(c in byte_of for c in chars):
            out.add(bytes(byte_of[c] for c in chars))
    return out


class Automaton:
    """``count(word)``: pieces of a word; 1 if some part of it is in no piece, as an unknown word is one token."""

    def __init__(self, vocabulary: set[bytes]) -> None:
        self.child: list[dict[int, int]] = [{}]
        final = [False]
        for piece in vocabulary:
            node = 0
            for b in piece:
                node = self.child[node].setdefault(b, len(self.child))
                if node == len(final):
                    self.child.append({})
                    final.append(False)
            final[node] = True
        self.fail = [-1] * len(final)
        self.popped = [0] * len(final)
        level = [0]
        while level:
            deeper = []
            for node in level:
                for b, to in self.child[node].items():
                    deeper.append(to)
                    if final[to]:
                        self.fail[to], self.popped[to] = 0, 1
                        continue
                    at, n = self.fail[node], self.popped[node]
                    while at >= 0 and b not in self.child[at]:
                        n += self.popped[at]
                        at = self.fail[at]
                    if at >= 0:
                        self.fail[to], self.popped[to] = self.child[at][b], n
            level = deeper

    def count(self, word: bytes) -> int:
        child, fail, popped = self.child, self.fail, self.popped
        node = n = 0
        for b in word:
            while (to := child[node].get(b)) is None:
                n += popped[node]
                node = fail[node]
                if node < 0:
                    return 1
            node = to
        while node:
            n += popped[node]
            node = fail[node]
            if node < 0:
                return 1
        return n


@lru_cache(maxsize=1)
def automaton(path: str) -> tuple[Automaton, dict[bytes, int]]:
    return Automaton(byte_vocabulary(path)), {}


def token_counts(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", cache_words: int = 1_000_000, longest: int = 64) -> DataFrame:
    """doc_id, n_words, n_punctuation, n_tokens (pieces of the words, and one for each punctuation character).

    A-Z become a-z; words are token words. A null or empty text has 0 of each. Null ids stay, repeated rows are counted
    each, other columns are ignored, an empty table gives no rows. A worker keeps the counts of ``cache_words`` words at
    most, none above ``longest`` bytes. Ids are whole numbers, or strings of such.
    """

    def count(batches):
        machine, known = automaton(vocabulary_path)
        for batch in batches:
            n_words, n_marks, n_tokens = [], [], []
            for raw in text_bytes(batch.column(1)):
                words = token_words(raw)
                if len(known) > cache_words:
                    known.clear()
                long = {}
                for w in set(words).difference(known):
                    (known if len(w) <= longest else long)[w] = machine.count(w)
                marks = len(raw.translate(LOWER_TABLE, _NOT_PUNCTUATION))
                n_words.append(len(words))
                n_marks.append(marks)
                n_tokens.append((sum(long[w] if w in long else known[w] for w in words) if long else sum(map(known.__getitem__, words))) + marks)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (n_words, n_marks, n_tokens))], names=["doc_id", "n_words", "n_punctuation", "n_tokens"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(frugal(count), "doc_id long, n_words long, n_punctuation long, n_tokens long")

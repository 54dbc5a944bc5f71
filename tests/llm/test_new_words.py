"""What the tokenizers library is given of words that the cache lacks."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from tessera.llm import encode
from tessera.llm.encode import PieceEncoder

WORDS = public_tokenizers.path("word_bpe_49k.json")


class Counting:
    """A tokenizer that counts the characters it is given."""

    def __init__(self, inner):
        self.inner, self.given = inner, 0

    def encode_batch_fast(self, texts, **options):
        self.given += sum(map(len, texts))
        return self.inner.encode_batch_fast(texts, **options)


def counted(tool):
    """What counts for every tokenizer that ``tool`` calls."""
    found = [name for name in ("tokenizer", "model") if getattr(tool, name, None)]
    for name in found:
        setattr(tool, name, Counting(getattr(tool, name)))
    return lambda: sum(getattr(tool, name).given for name in found)


def test_a_word_is_given_once_whatever_marks_follow():
    draw = random.Random(5)
    stems = sorted({"".join(draw.choice("aeinrstlßéö") for _ in range(9)) for _ in range(2000)})
    text = " ".join(s + tail for tail in ("", "&&&", ",", "!!", ").", "$$$") for s in stems)
    tool = PieceEncoder(WORDS)
    want, given = tool.whole([text]), counted(tool)
    assert tool.encode([text]) == want
    assert given() < 11 * len(stems)  # nine letters and a space, and the marks once


def test_old_pieces_outlive_a_new_start_of_the_cache():
    tool = PieceEncoder(WORDS, limit=200)
    word = lambda i: "w" + "".join("abcdefghij"[int(x)] for x in str(i))
    first = " ".join(map(word, range(1000, 1100)))
    tool.encode([first])
    for i in range(2000, 9000, 100):
        tool.encode([" ".join(map(word, range(i, i + 100)))])
        given = counted(tool)
        tool.encode([first])
        assert given() == 0


@pytest.mark.parametrize(("narrow", "group"), [(False, 1 << 24), (True, 1 << 24), (True, 50)])
def test_lowered_words_have_the_ids_of_the_whole(monkeypatch, narrow, group):
    monkeypatch.setattr(encode, "_GROUP", group)
    draw, tool = random.Random(6), PieceEncoder(WORDS, limit=300, narrow=narrow)
    assert tool.width == (2 if narrow else 4)
    some = ["a", "ing", "É", "ß", "ÿ", "ª", "º", "µ", "×", "÷", "²", "¼", "¡", "§", "1", "_", "'", "'s", "'LL", "&", "|", "~", "</w>", ".", ",", "-", "Z", " ", " ", " ", "\n", "\xa0", "\xad", "Σ", "–", "ﬁ"]
    texts = ["".join(draw.choice(some[: draw.choice([12, 33, 36])]) for _ in range(draw.randrange(30))) + draw.choice(["", " the end."]) for _ in range(4000)]
    for i in range(0, len(texts), 100):
        assert tool.encode(texts[i : i + 100]) == tool.whole(texts[i : i + 100])
    assert np.frombuffer(tool.whole(["the end."])[0], dtype=tool.kind).max() > 255


def test_tails_follow_letters_and_digits():
    words = ["ab&&&", "é!", "1.", "it's,", "&&", "a'.", "x×,", "y÷.", "²,", "ab", "", "a.b."]
    stems, tails = encode.without_tails(pa.array(words))
    assert stems.to_pylist() == ["ab", "é", "1", "it's", "&&", "a'.", "x×,", "y÷.", "²,", "ab", "", "a.b"]
    assert tails.to_pylist() == ["&&&", "!", ".", ",", "", "", "", "", "", "", "", "."]
    assert [x.to_pylist() for x in encode.without_tails(pa.array(["", ""]))] == [["", ""], ["", ""]]

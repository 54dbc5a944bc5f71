"""Exact token ids from the tokenizers library, with what it gave for a piece of text kept for the next time.

No rule of the tokenizers that are used here looks across white space, except that a run of it belongs to what follows
or to the end of the text. So a text whose white space is single spaces and single line ends may be cut before each of
them, and the ids of the pieces joined are the ids of the whole. A full stop or comma after a letter, at the end of a
piece, is a token of its own. Where a tokenizer drops white space, pieces are words; where it lowers case too, Latin-1
texts are lowered first, so that fewer words are new. New pieces go to the library many at a time, parted by a mark that is one token and stands
in none of them. Any other text, and any that may hold a special token, is encoded whole.

Where a vocabulary also tells ends of words, lowered texts are split, and their words numbered and replaced by ids, as Arrow
arrays of many texts; Python sees each distinct one once. Marks behind a letter or digit (``word&&&``) share no token with
it, so they are looked up apart. New words of letters need no mark between them and none of the tokenizer's steps that lower,
compose and split: its model gets them parted by spaces, and each ends with the token that ends a word.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_LETTER_AND_STOP = re.compile("[A-Za-zÀ-ÖØ-öø-ɏ][.,]\\Z")
_MARKS = ("\n", "\n~\n", "\n|\n", "\n§\n")
_TAIL = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"  # the apostrophe may begin a token of letters
_MOST, _GROUP = 1 << 27, 1 << 24  # characters of one text in an array (its ids stay below 2 GB), and of several together
_ENDS = np.zeros(256, dtype=bool)
_ENDS[list(b"abcdefghijklmnopqrstuvwxyz0123456789")] = True
_LETTERS = "aàáâãäåæçbèéêëcìíîïdðñeòóôõöøfùúûüýþgÿßhªµºijklmnopqrstuvwxyz"


def may_be_cut(text: str) -> bool:
    """No white space beside white space or at an end, none but space and line end, no control or format characters."""
    if "  " in text or "\n\n" in text or " \n" in text or "\n " in text or "<|" in text or text[:1] in " \n" or text[-1] in " \n":
        return False
    return text.replace("\n", "").isprintable()


def without_tails(words: pa.StringArray) -> tuple[pa.StringArray, pa.StringArray]:
    """Lower-case Latin-1 words up to the _TAIL marks that follow a letter or digit at their ends, and those marks."""
    _, offsets, data = words.buffers()
    raw = np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, dtype=np.uint8)
    if not len(raw):
        return words, words
    offsets = np.frombuffer(offsets, dtype=np.int32)[words.offset : words.offset + len(words) + 1]
    stems = pc.ascii_rtrim(words, _TAIL)
    kept, size = pc.binary_length(stems).to_numpy(), np.diff(offsets)
    last = np.maximum(offsets[:-1] + kept - 1, 0)
    byte = raw[last]
    letter = _ENDS[byte] | ((raw[np.maximum(last - 1, 0)] == 0xC3) & (byte >= 0x80) & (byte != 0x97) & (byte != 0xB7))  # no signs of times and division
    cut = letter & (kept > 0) & (kept < size)
    n = np.where(cut, size - kept, 0)
    ends = np.cumsum(n)
    at = np.repeat(offsets[1:] - ends, n) + np.arange(ends[-1])
    tails = pa.StringArray.from_buffers(len(words), pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32)), pa.py_buffer(raw[at]))
    return pc.if_else(pa.array(cut), stems, words), tails


class PieceEncoder:
    """``encode(texts)`` gives each text's ids as little-endian unsigned bytes: 32 bits an id, or 16 if ``narrow`` and all
    of the vocabulary's ids fit (``width`` bytes).

    The cache holds ``limit`` pieces at most, none above ``longest`` characters. Once full it is used as it is, and its
    younger half starts anew when as many pieces again were not found in it; so memory has a bound and results don't
    depend on it.
    """

    def __init__(self, path: str, limit: int = 700_000, longest: int = 64, narrow: bool = False) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.limit, self.longest, self.strange = limit, longest, 0
        self.cache: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        most = max(vocabulary.values(), default=0)
        self.width = 2 if narrow and most < 1 << 16 else 4
        self.kind = f"<u{self.width}"
        self.stops = dict(zip(".,", self.whole([".", ","]), strict=True))
        joined = b"".join(self.whole(["Ab", "cd"]))
        self.drops_space = all(x == joined for x in self.whole(["Ab cd", "Ab\ncd", " Ab \n cd\n"])) and self.whole([" \n"]) == [b""]
        self.lowers = self.drops_space and len(set(self.whole(["ABC ÀÉ Þ", "abc àé þ"]))) == 1
        self.mark, self.mark_id = next(((m, int.from_bytes(x, "little")) for m, x in zip(_MARKS, self.whole(list(_MARKS)), strict=True) if len(x) == self.width), ("", -1))
        self.model = None
        if self.lowers and (suffix := getattr(self.tokenizer.model, "end_of_word_suffix", None)):
            self._take_model(Tokenizer(self.tokenizer.model), suffix, vocabulary, most)

    def _take_model(self, model, suffix: str, vocabulary: dict[str, int], most: int) -> None:
        """Use ``model`` for words of letters, if it and the tokenizer agree on all letters, and on marks behind them."""
        from tokenizers import pre_tokenizers

        model.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.ends = np.zeros(most + 1, dtype=bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
        self.model = model
        words = [*_LETTERS, *(_LETTERS[i : i + n] for n in (2, 3, 5, len(_LETTERS)) for i in range(len(_LETTERS)))]
        marks = [*_TAIL, *(_TAIL[i : i + 2] for i in range(len(_TAIL) - 1)), _TAIL]
        behind = all(self.whole([stem + x for x in marks]) == [self.whole([stem])[0] + x for x in self.whole(marks)] for stem in ("ab", "é", "a1", "it's"))
        if self._of_letters(words) != self.whole(words) or not behind:
            self.model = None

    def whole(self, texts: list[str]) -> list[bytes]:
        out = []
        for i in range(0, len(texts), 512):
            out += [np.array(e.ids, dtype=self.kind).tobytes() for e in self.tokenizer.encode_batch_fast(texts[i : i + 512], add_special_tokens=False)]
        return out

    def _parted(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces without the mark, from texts of many."""
        out: list[bytes] = []
        for i in range(0, len(pieces), 1000):
            ids = np.array(self.tokenizer.encode_batch_fast([self.mark.join(pieces[i : i + 1000])], add_special_tokens=False)[0].ids, dtype=self.kind)
            ends = np.flatnonzero(ids == self.mark_id).tolist()
            raw, w = ids.tobytes(), self.width
            out += [raw[w * a : w * b] for a, b in zip([0, *(e + 1 for e in ends)], [*ends, len(ids)], strict=True)]
        return out

    def _of_letters(self, words: list[str]) -> list[bytes]:
        """Ids of words of lower-case Latin-1 letters, from the model alone."""
        out: list[bytes] = []
        for i in range(0, len(words), 1000):
            part = words[i : i + 1000]
            ids = np.array(self.model.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, dtype=self.kind)
            ends = ((np.flatnonzero(self.ends[ids]) + 1) * self.width).tolist()
            raw = ids.tobytes()
            out += [raw[a:b] for a, b in zip([0, *ends], ends)] if len(ends) == len(part) else self.whole(part)  # noqa: B905
        return out

    def _learn_lowered(self, pieces: list[str]) -> dict[str, bytes]:
        """Ids of distinct pieces of lowered Latin-1 texts that the cache lacks."""
        words = [p for p in pieces if p.isalpha()]
        got = dict(zip(words, self._of_letters(words), strict=True))
        if len(words) < len(pieces):
            got.update(self._learn({p for p in pieces if p and not p.isalpha()}))
            got[""] = b""
        return got

    def _learn(self, pieces: set[str]) -> dict[str, bytes]:
        """Ids of pieces that the cache lacks. Those that end in a stop come from what stands before it."""
        stems = {p: p[:-1] for p in pieces if _LETTER_AND_STOP.search(p)}
        todo = {stems.get(p, p) for p in pieces}.difference(self.cache)
        mark = self.mark.strip() or self.mark
        plain = [p for p in todo if mark not in p] if self.mark_id >= 0 else []
        rest = list(todo.difference(plain))
        got = dict(zip(plain, self._parted(plain), strict=True)) if plain else {}
        got.update(zip(rest, self.whole(rest), strict=True))
        for p, stem in stems.items():
            got[p] = (got[stem] if stem in got else self.cache[stem]) + self.stops[p[-1]]
        return got

    def _keep(self, learnt: dict[str, bytes]) -> None:
        if len(self.cache) < self.limit:
            self.cache.update((p, x) for p, x in learnt.items() if len(p) <= self.longest)
        elif (strange := self.strange + len(learnt)) > self.limit:
            self.cache, self.strange = dict(islice(self.cache.items(), self.limit // 2)), 0
        else:
            self.strange = strange

    def _lowered(self, text: str) -> str | None:
        """The text in lower case if it is Latin-1 and its only white space are spaces and line ends.

        Beyond Latin-1 lowering may depend on what stands beside a character, or on its composed form.
        """
        if len(text) > _MOST or "<|" in text or not text.replace("\n", "").isprintable():
            return None
        if not text.isascii():
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                return None
        return text.lower()

    def _ids(self, pieces: pa.StringArray) -> pa.BinaryArray:
        """Ids of each piece of lowered texts."""
        found = pieces.dictionary_encode()
        n = len(found.dictionary)
        words = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), found.dictionary), "\n")[0].as_py().split("\n")
        ids = list(map(self.cache.get, words))
        if None in ids:
            at = [i for i, x in enumerate(ids) if x is None]
            learnt = self._learn_lowered([words[i] for i in at])
            for i in at:
                ids[i] = learnt[words[i]]
            self._keep(learnt)
        return pa.array(ids, pa.binary()).take(found.indices)

    def _of_lowered(self, texts: list[str]) -> list[bytes]:
        """Ids of lowered texts."""
        lists = pc.ascii_split_whitespace(pa.array(texts, pa.string()))
        found = lists.values.dictionary_encode()
        ids = pc.binary_join_element_wise(*map(self._ids, without_tails(found.dictionary)), b"")
        _, offsets, data = ids.take(found.indices).buffers()
        raw = data.to_pybytes() if data else b""
        ends = np.frombuffer(offsets, dtype=np.int32)[lists.offsets.to_numpy()].tolist()
        return [raw[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]

    def encode(self, texts: list[str]) -> list[bytes]:
        if self.model is None:
            return self._by_pieces(texts)
        out, rest = [b""] * len(texts), []
        places: list[int] = []
        lowered: list[str] = []
        held = 0

        def flush() -> None:
            for n, ids in zip(places, self._of_lowered(lowered) if lowered else [], strict=True):
                out[n] = ids
            places.clear()
            lowered.clear()

        for n, text in enumerate(texts):
            if not text:
                continue
            low = self._lowered(text)
            if low is None:
                rest.append(n)
                continue
            if held + len(low) > _GROUP:
                flush()
                held = 0
            held += len(low)
            places.append(n)
            lowered.append(low)
        flush()
        if rest:
            for n, ids in zip(rest, self._by_pieces([texts[n] for n in rest]), strict=True):
                out[n] = ids
        return out

    def _pieces(self, text: str) -> list[str] | None:
        """Pieces whose ids, joined, are the text's; none if it can't be cut."""
        if not self.drops_space:
            return text.replace("\n", "\x00\n\x00").replace(" ", "\x00 ").split("\x00") if may_be_cut(text) else None
        if "<|" in text or not text.replace("\n", "").isprintable():
            return None
        if self.lowers:
            try:  # beyond Latin-1 lowering may depend on what stands beside a character, or on its composed form
                text.encode("latin-1")
                text = text.lower()
            except UnicodeEncodeError:
                pass
        return text.split()

    def _by_pieces(self, texts: list[str]) -> list[bytes]:
        find = self.cache.get
        out: list = []
        gaps: list[tuple[int, list[int], list[str]]] = []
        missing: set[str] = set()
        for n, text in enumerate(texts):
            pieces = self._pieces(text) if text else []
            if pieces is None:
                out.append(None)
                continue
            known = list(map(find, pieces))
            out.append(known)
            if None in known:
                at = [i for i, x in enumerate(known) if x is None]
                new = [pieces[i] for i in at]
                missing.update(new)
                gaps.append((n, at, new))
        learnt = self._learn(missing) if missing else {}
        for n, at, new in gaps:
            known = out[n]
            for i, p in zip(at, new, strict=True):
                known[i] = learnt[p]
        rest = [n for n, x in enumerate(out) if x is None]
        out = [None if x is None else b"".join(x) for x in out]
        for n, ids in zip(rest, self.whole([texts[n] for n in rest]), strict=True):
            out[n] = ids
        self._keep(learnt)
        return out


@lru_cache(maxsize=1)
def encoder(path: str, limit: int = 700_000, narrow: bool = False) -> PieceEncoder:
    """One for a worker process; it is built anew for another vocabulary, size of cache or width of ids."""
    return PieceEncoder(path, limit, narrow=narrow)

"""What the operators of this subpackage share: word rules, shared storage, hashing over Arrow buffers.

Word rules
    *Token words* are runs of ASCII letters, ASCII digits and any non-ASCII character, after A-Z became a-z.
    *Space words* are runs of anything but ASCII white space (0x20, 0x09-0x0D).
    Both are rules on bytes: in UTF-8 every byte of a non-ASCII character is at least 0x80, so a byte table and
    ``bytes.split`` give the same words as the rule on characters, without decoding the text.
"""

from __future__ import annotations

import ctypes
import hashlib
import re
import sys
import tempfile
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TOKEN_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SPACE_WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _token_table() -> bytes:
    table = bytearray(b" " * 256)
    for byte in range(256):
        char = chr(byte)
        if byte >= 0x80 or "0" <= char <= "9" or "a" <= char <= "z":
            table[byte] = byte
        elif "A" <= char <= "Z":
            table[byte] = byte + 32
    return bytes(table)


TOKEN_TABLE = _token_table()
LOWER_TABLE = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def token_words(raw: bytes) -> list[bytes]:
    return raw.translate(TOKEN_TABLE).split()


def shared_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which all executors share.

    Where that is unset, a session on one machine gets a temporary folder; a cluster gets an error, as its executors
    would each write to a disk of their own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/tessera-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut and a lost executor costs nothing."""
    path = f"{shared_dir(df.sparkSession)}/{name}"
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """The UTF-8 bytes of each text; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def frugal(work, rows: int = 1000):
    """A mapInArrow function that sees ``rows`` rows at a time and, when its task ends, hands freed memory back.

    Workers live on between tasks; what their allocators keep would otherwise count against the executor.
    """

    def run(batches):
        try:
            yield from work(b.slice(at, rows) for b in batches for at in range(0, b.num_rows, rows))
        finally:
            pa.default_memory_pool().release_unused()
            if sys.platform == "linux":
                ctypes.CDLL(None).malloc_trim(0)

    return run


# --- maps of keys ----------------------------------------------------------------------------------------------------
def key_map(keys: DataFrame, most_bits: int = 26) -> np.ndarray:
    """Bits of the hashes of ``key``, 32 for each row if so many are allowed. What reaches the driver are the map's words."""
    bits = min(most_bits, max(16, (32 * keys.count()).bit_length()))
    slot = F.shiftrightunsigned(F.xxhash64("key"), 64 - bits).alias("slot")
    bit = F.expr("shiftleft(1L, CAST(slot & 63 AS INT))")
    words = keys.select(slot).groupBy(F.shiftright("slot", 6).alias("w")).agg(F.bit_or(bit).alias("b")).toArrow()
    out = np.zeros(1 << (bits - 6), dtype=np.uint64)
    out[words.column("w").to_numpy()] = words.column("b").to_numpy().view(np.uint64)
    return out


def may_hold(key: str, bits: np.ndarray) -> Column:
    """Whether a key may be among those of ``bits``; false for no such key. Only hashes of keys go to Python."""
    shared = SparkSession.getActiveSession().sparkContext.broadcast(bits)
    shift = np.uint64(64 - (len(bits) * 64 - 1).bit_length())

    def test(hashes: pd.Series) -> pd.Series:
        at = hashes.to_numpy().view(np.uint64) >> shift
        return pd.Series((shared.value[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool))

    return F.pandas_udf(test, "boolean")(F.xxhash64(key))


# --- vectorised hashing of words -----------------------------------------------------------------------------------
LONG_WORD = 64
_KEY = b"tessera words"
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)
_SEEDS = tuple(np.uint64(x) for x in (0x9AE16A3B2F90404F, 0xC3A5C85C97CB3127))
_STEPS = tuple(np.uint64(x) for x in (0x2545F4914F6CDD1D, 0x9FB21C651E98DF25))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose output bits all depend on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_FACTORS = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def digest(raw: bytes) -> bytes:
    """128 bits that tell byte strings apart."""
    return hashlib.blake2b(raw, digest_size=16, key=_KEY).digest()


def word_hashes(raw: bytes, parts: int = 1) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """64-bit hashes of the space words of ``raw`` (``parts`` of them, one or two), and the words' starts and ends.

    A word is read eight bytes at a time, and each step is mixed before the next, so no word is cut out in Python; words
    above LONG_WORD bytes take a keyed digest. Both parts together tell words apart; one alone is for filters and buckets.
    """
    word = np.empty(len(raw) + 2, dtype=bool)
    word[0] = word[-1] = False
    np.logical_not(_SPACE[np.frombuffer(raw, dtype=np.uint8)], out=word[1:-1])
    edges = np.flatnonzero(word[1:] != word[:-1])
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return [np.zeros(0, dtype=np.uint64)] * parts, starts, ends
    eight = np.ndarray(len(raw), dtype="<u8", buffer=raw + bytes(8), strides=(1,))  # the eight bytes from each on
    length = ends - starts
    chunk = eight[starts] & _MASKS[np.minimum(length, 8)]
    out = [mix(length.astype(np.uint64) * _STEPS[p] + chunk ^ _SEEDS[p]) for p in range(parts)]
    left = np.flatnonzero(length > 8)
    for at in range(8, LONG_WORD, 8):
        if not len(left):
            break
        chunk = eight[starts[left] + at] & _MASKS[np.minimum(length[left] - at, 8)]
        for p in range(parts):
            out[p][left] = mix(out[p][left] * _STEPS[p] + chunk)
        left = left[length[left] > at + 8]
    for i in left.tolist():
        both = np.frombuffer(digest(raw[starts[i] : ends[i]]), dtype="<u8")
        for p in range(parts):
            out[p][i] = both[p]
    return out, starts, ends


def shingled(words: np.ndarray, k: int) -> np.ndarray:
    """One hash for each k-word shingle, in order; fewer words, but not none, are one shingle."""
    k_now = min(k, len(words))
    n = len(words) - k_now + 1
    out = words[:n] * _FACTORS[0]
    for j in range(1, k_now):
        out += words[j : n + j] * _FACTORS[j]
    if k_now < k:  # a short text never equals a shingle of a longer one
        out += _FACTORS[k - k_now]
    return mix(out)


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; fewer words, but not none, are one shingle."""
    return np.unique(shingled(words, k)) if len(words) else words


def shingle_pairs(words: list[np.ndarray], k: int) -> np.ndarray:
    """Sorted distinct 128-bit hashes of the k-word shingles, shape (shingles, 2), from both parts of the words' hashes."""
    if not len(words[0]):
        return np.zeros((0, 2), dtype=np.uint64)
    a, b = shingled(words[0], k), shingled(words[1], k)
    order = np.argsort(a)
    a, b = a[order], b[order]
    same = a[1:] == a[:-1]
    if same.any():
        if (same & (b[1:] != b[:-1])).any():  # two shingles of equal first halves
            order = np.lexsort((b, a))
            a, b = a[order], b[order]
            same = a[1:] == a[:-1]
        new = np.concatenate([[True], ~(same & (b[1:] == b[:-1]))])
        a, b = a[new], b[new]
    return np.stack([a, b], axis=1)


# --- hot keys --------------------------------------------------------------------------------------------------------
HOT_KEYS = 300_000


def with_one_a_key(rows: DataFrame, ones: DataFrame, key: str, count: str, n_rows: int, least: int = 512) -> DataFrame:
    """``rows`` inner-joined with ``ones``, which has one row a key and the key's number of rows in ``count``.

    Keys of more than max(``least``, n_rows / HOT_KEYS) rows are fewer than HOT_KEYS, so they are broadcast, and their
    rows stay where they are; a key that is shuffled has no more rows than that. ``n_rows``: the rows there are, or
    more.
    """
    most = max(least, n_rows // HOT_KEYS)
    if n_rows <= most:
        return rows.join(ones, key)
    hot = ones.where(F.col(count) > most)
    names = [c for c in ones.columns if c != key]
    told = rows.join(F.broadcast(hot), key, "left")
    warm = told.where(F.col(count).isNotNull())
    cold = told.where(F.col(count).isNull()).drop(*names).join(ones.where(F.col(count) <= most), key)
    return warm.select(*cold.columns).union(cold)

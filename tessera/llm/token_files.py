"""Operator 5: token ids in binary shards with a minimal perfect hash index.

Documents are ranged by id in shards of about ``shard_bytes`` of text, of more if there would be over MOST_SHARDS. The ranges
come from keys and lengths alone, so texts are encoded once, where they are read, and only their ids are shuffled, each
straight to its shard. A shard file holds, in order: the raw ids of its documents (little-endian, 2 bytes each if the
vocabulary allows, else 4) in blocks, then one footer block. The footer has the documents' ids in order, a minimal perfect
hash over the keys with the rank of each of its words of bits, and for each slot a fingerprint of the key, the byte offset of
its ids and their number. A manifest beside the shards has a row for each: its range of ids and its size.

A lookup finds the shard by a binary search of the manifest. In the shard it hashes the key, reads one word of bits and its
rank for each level it passes (1.6 on average), then one slot: the same few reads whatever the number of documents. A key
that isn't there fails the fingerprint.

Shards are written by Spark's own text writer, one record a block, so any file system that Spark writes works and a lost
task leaves nothing behind. A byte array cast to a string is written as it is, and one line end follows each block.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import frugal, materialise, mix, shared_dir
from .encode import encoder

MAGIC = b"TSRATOK2"
_HEAD = struct.Struct("<8sIIQQQ")  # magic, width, levels, documents, ids, left over
_TAIL = struct.Struct("<Q8s")  # bytes of the footer before this, magic
_SLOT = np.dtype([("print", "<u4"), ("offset", "<u8"), ("count", "<u8")])
BLOCK_BYTES = 8 << 20
SHARD_BYTES, MOST_SHARDS = 16 << 20, 500_000
_NULL = 1 << 40  # what is added to the occurrence of a null id


# --- minimal perfect hash --------------------------------------------------------------------------------------------
def key_hashes(doc_ids: np.ndarray, nth: np.ndarray) -> np.ndarray:
    """64-bit keys; ``nth`` tells rows of equal id apart."""
    return mix(mix(doc_ids.astype(np.int64).view(np.uint64) + np.uint64(0x632BE59BD9B4E019)) ^ mix(nth.astype(np.uint64)) * np.uint64(3))


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mix(keys ^ np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)).astype("<u4")


def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix(keys + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) % np.uint64(size)).astype(np.int64)


@dataclass
class Level:
    """A bit array: its size, its words, and how many bits are set before each word, those of earlier levels too."""

    size: int
    words: np.ndarray
    ranks: np.ndarray

    @staticmethod
    def of(bits: np.ndarray, before: int) -> Level:
        raw = np.packbits(bits, bitorder="little")
        words = np.frombuffer(raw.tobytes() + b"\0" * (-len(raw) % 8), dtype="<u8")
        ones = np.bitwise_count(words).astype(np.uint64)
        return Level(len(bits), words, np.uint64(before) + np.cumsum(ones) - ones)

    @staticmethod
    def n_words(size: int) -> int:
        return -(-size // 64)


def _found(word: np.ndarray, rank: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Slots of the bits ``at``, given their words and ranks; -1 where the bit isn't set."""
    bit = (at & 63).astype(np.uint64)
    slot = rank + np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
    return np.where(word >> bit & np.uint64(1), slot.astype(np.int64), -1)


@dataclass
class PerfectHash:
    """A cascade of bit arrays. A key lives on the first level on which it met no other key; its slot is the rank of its
    bit among all bits. Keys that share all 64 bits are kept aside, in ``left``."""

    levels: list[Level]
    left: np.ndarray
    n: int = field(default=0)  # keys on levels

    @staticmethod
    def build(keys: np.ndarray, gamma: float = 2.0, most: int = 40) -> PerfectHash:
        levels, n = [], 0
        while len(keys) and len(levels) < most:
            size = max(64, int(len(keys) * gamma))
            at = _place(keys, len(levels), size)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(Level.of(alone, n))
            n += int(alone.sum())
            keys = keys[~alone[at]]
        return PerfectHash(levels, np.sort(keys), n)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key; -1 if it is known not to be there. Any other answer is to be tested by fingerprint."""
        out = np.full(len(keys), -1, dtype=np.int64)
        todo = np.arange(len(keys))
        for i, level in enumerate(self.levels):
            at = _place(keys[todo], i, level.size)
            out[todo] = _found(level.words[at >> 6], level.ranks[at >> 6], at)
            todo = todo[out[todo] < 0]
            if not len(todo):
                return out
        if len(self.left):
            at = np.searchsorted(self.left, keys[todo])
            ok = (at < len(self.left)) & (self.left[np.minimum(at, len(self.left) - 1)] == keys[todo])
            out[todo[ok]] = self.n + at[ok]
        return out


# --- one shard -------------------------------------------------------------------------------------------------------
def footer(doc_ids: list[int | None], offsets: list[int], counts: list[int], width: int) -> bytes:
    ids = np.array([x or 0 for x in doc_ids], dtype=np.int64)
    null = np.array([x is None for x in doc_ids], dtype=bool)
    nth = occurrence(ids, null)
    keys = key_hashes(ids, nth)
    tree = PerfectHash.build(keys)
    slots = tree.slots(keys)
    if len(tree.left):  # equal 64-bit keys: each takes one of the slots of its run
        order = np.argsort(slots, kind="stable")
        same = np.flatnonzero(np.diff(slots[order], prepend=-1) == 0)
        slots[order[same]] += 1
    table = np.zeros(len(ids), dtype=_SLOT)
    table["print"][slots], table["offset"][slots], table["count"][slots] = fingerprints(keys), offsets, counts
    out = [_HEAD.pack(MAGIC, width, len(tree.levels), len(ids), sum(counts), len(tree.left)), np.array([x.size for x in tree.levels], dtype="<u8").tobytes()]
    for level in tree.levels:
        out += [level.words.tobytes(), level.ranks.astype("<u8").tobytes()]
    out += [tree.left.astype("<u8").tobytes(), table.tobytes(), ids.astype("<i8").tobytes(), np.packbits(null).tobytes()]
    body = b"".join(out)
    return body + _TAIL.pack(len(body), MAGIC)


class Layout:
    """Where the parts of a footer are, from its head and the sizes of its levels; ``at`` counts from the footer's start."""

    def __init__(self, head: bytes) -> None:
        magic, self.width, self.n_levels, self.n, self.n_ids, self.n_left = _HEAD.unpack(head[: _HEAD.size])
        if magic != MAGIC:
            raise ValueError("not a token shard")
        self.sizes_at = _HEAD.size

    def sized(self, sizes: bytes) -> Layout:
        self.sizes = np.frombuffer(sizes, dtype="<u8").astype(np.int64).tolist()
        at, self.words_at, self.ranks_at = self.sizes_at + 8 * self.n_levels, [], []
        for size in self.sizes:
            n = 8 * Level.n_words(size)
            self.words_at.append(at)
            self.ranks_at.append(at + n)
            at += 2 * n
        self.left_at = at
        self.table_at = at + 8 * self.n_left
        self.ids_at = self.table_at + _SLOT.itemsize * self.n
        self.null_at = self.ids_at + 8 * self.n
        return self


def occurrence(ids: np.ndarray, null: np.ndarray) -> np.ndarray:
    """How many rows of the same id stand before each row, ids being in order; nulls, first, are an id of their own."""
    new = np.ones(len(ids), dtype=bool)
    new[1:] = (ids[1:] != ids[:-1]) | (null[1:] != null[:-1])
    first = np.maximum.accumulate(np.where(new, np.arange(len(ids)), 0))
    return np.arange(len(ids)) - first + null.astype(np.int64) * _NULL


class Shard:
    """A shard's bytes, with keyed and ordered access."""

    def __init__(self, raw: bytes) -> None:
        raw = memoryview(raw)
        end = len(raw) - 1  # the last block's line end
        size, magic = _TAIL.unpack(raw[end - _TAIL.size : end])
        if magic != MAGIC:
            raise ValueError("not a token shard")
        body = raw[end - _TAIL.size - size : end - _TAIL.size]
        at = Layout(body)
        at = at.sized(body[at.sizes_at : at.sizes_at + 8 * at.n_levels])
        take = lambda start, n, kind: np.frombuffer(body[start : start + n * np.dtype(kind).itemsize], dtype=kind)
        self.width, self.n_ids = at.width, at.n_ids
        self.doc_ids = take(at.ids_at, at.n, "<i8")
        self.null = np.unpackbits(take(at.null_at, (at.n + 7) // 8, np.uint8), count=at.n).astype(bool)
        levels = [Level(size, take(w, Level.n_words(size), "<u8"), take(r, Level.n_words(size), "<u8")) for size, w, r in zip(at.sizes, at.words_at, at.ranks_at, strict=True)]
        self.tree = PerfectHash(levels, take(at.left_at, at.n_left, "<u8"), at.n - at.n_left)
        self.table = take(at.table_at, at.n, _SLOT)
        self.raw = raw

    def find(self, doc_ids: np.ndarray, nth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte offset and count of each key's ids; -1 and 0 for keys that aren't here."""
        keys = key_hashes(doc_ids, nth)
        slots = self.tree.slots(keys)
        rows = self.table[np.maximum(slots, 0)] if len(self.table) else np.zeros(len(keys), dtype=self.table.dtype)
        ok = (slots >= 0) & (rows["print"] == fingerprints(keys)) & (len(self.table) > 0)
        return np.where(ok, rows["offset"].astype(np.int64), -1), np.where(ok, rows["count"].astype(np.int64), 0)

    def ids(self, offset: int, count: int) -> np.ndarray:
        return np.frombuffer(self.raw[offset : offset + count * self.width], dtype=f"<u{self.width}").astype("<u4")


@dataclass
class Ranges:
    """Shards by their last keys, the last shard's aside: (id, tie, row) in order, those of null ids first."""

    nulls: int
    ids: np.ndarray
    ties: np.ndarray
    rows: np.ndarray

    @staticmethod
    def of(keys: DataFrame, shard_bytes: int) -> Ranges:
        """``keys``: doc_id, tie, row, bytes. Twice as many ranges as shards are needed are joined until they have their bytes."""
        total = keys.agg(F.sum("bytes")).first()[0] or 0
        shard_bytes = max(shard_bytes, -(-total // MOST_SHARDS))
        fine = keys.repartitionByRange(max(1, 2 * -(-total // shard_bytes)), "doc_id", "tie", "row").groupBy(F.spark_partition_id().alias("p"))
        found = fine.agg(F.max(F.struct("doc_id", "tie", "row")).alias("last"), F.sum("bytes").alias("bytes")).orderBy("p").select("last.*", "bytes").toArrow()
        held, cuts = 0, []
        for i, size in enumerate(found.column("bytes").to_pylist()[:-1]):
            held += size
            if held >= 0.75 * shard_bytes:
                cuts.append(i)
                held = 0
        found = found.take(pa.array(cuts, pa.int64()))
        ids = found.column("doc_id").to_pylist()
        array = lambda xs: np.array(xs, dtype=np.int64)
        return Ranges(ids.count(None), array([x for x in ids if x is not None]), array(found.column("tie").to_pylist()), array(found.column("row").to_pylist()))

    def of_keys(self, doc_ids: list[int | None], ties: list[int], rows: list[int]) -> list[int]:
        """The shard of each key."""
        null = np.array([x is None for x in doc_ids], dtype=bool)
        ids = np.array([x or 0 for x in doc_ids], dtype=np.int64)
        first = np.where(null, 0, self.nulls + np.searchsorted(self.ids, ids, side="left"))
        last = np.where(null, self.nulls, self.nulls + np.searchsorted(self.ids, ids, side="right"))
        out = first.tolist()
        for i in np.flatnonzero(first < last).tolist():  # shards that end within this id
            lo, hi = out[i], int(last[i])
            while lo < hi:
                mid = (lo + hi) // 2
                if (self.ties[mid], self.rows[mid]) < (ties[i], rows[i]):
                    lo = mid + 1
                else:
                    hi = mid
            out[i] = lo
        return out

    def __len__(self) -> int:
        return len(self.ties) + 1


def write_shards(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> None:
    """Encode every whole text and write the shards, in ascending order of the id.

    Nulls come first; rows of equal id go by their texts' hashes and then by their place in ``docs``, and may stand in several
    shards. A null text is the end id alone. A document is in one shard, so a long one makes its shard larger.
    """

    def encode(batches):
        tool = encoder(tokenizer_path, 300_000, end_id < 1 << 16)
        width, end = tool.width, end_id.to_bytes(tool.width, "little")
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                raw = [x + end for x in tool.encode([x or "" for x in part.column(3).to_pylist()])]
                shard = ranges.value.of_keys(*(part.column(i).to_pylist() for i in range(3)))
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array([width] * len(raw), pa.int32()), pa.array(raw, pa.binary()), pa.array(shard, pa.int32())], names=["doc_id", "tie", "row", "width", "ids", "shard"])

    def write(batches):
        block: list[bytes] = []
        held = at = width = 0
        doc_ids, offsets, counts = [], [], []
        out = lambda x: pa.RecordBatch.from_arrays([pa.array([x], pa.binary())], names=["block"])
        for batch in batches:
            for key, width, raw in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):  # noqa: B007
                doc_ids.append(key)
                offsets.append(at)
                counts.append(len(raw) // width)
                block.append(raw)
                held, at = held + len(raw), at + len(raw)
                if held >= BLOCK_BYTES:
                    yield out(b"".join(block))
                    block, held, at = [], 0, at + 1
        if doc_ids:
            if block:
                yield out(b"".join(block))
            yield out(footer(doc_ids, offsets, counts, width))

    text = F.col(text_col)
    keys = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("tie"), F.monotonically_increasing_id().alias("row"), text.alias("text"))
    found = Ranges.of(keys.select("doc_id", "tie", "row", (F.coalesce(F.octet_length("text"), F.lit(0)) + 28).alias("bytes")), shard_bytes)
    ranges = docs.sparkSession.sparkContext.broadcast(found)
    rows = keys.mapInArrow(frugal(encode), "doc_id long, tie long, row long, width int, ids binary, shard int")
    dealt = rows.repartitionById(len(found), "shard").sortWithinPartitions("doc_id", "tie", "row").select("doc_id", "width", "ids")
    dealt.mapInArrow(frugal(write), "block binary").select(F.col("block").cast("string").alias("value")).write.option("lineSep", "\n").option("compression", "none").text(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """Every document of the shards, found through the index: shard (its name), place (its number in order), bytes (of the
    shard), doc_id, at (ids before it in the shard), n_tokens, ids_crc32."""

    def read(batches):
        for batch in batches:
            for where, place, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                data = raw.as_buffer()
                shard = Shard(data)
                offsets, counts = shard.find(shard.doc_ids, occurrence(shard.doc_ids, shard.null))
                if (offsets < 0).any():
                    raise ValueError(f"{where}: the index lacks keys")
                first, before = pa.array(shard.doc_ids, pa.int64(), mask=shard.null), np.cumsum(counts) - counts
                for lo in range(0, len(counts), 10_000):
                    part = slice(lo, lo + 10_000)
                    sums = [zlib.crc32(shard.ids(o, n).tobytes()) for o, n in zip(offsets[part].tolist(), counts[part].tolist(), strict=True)]
                    same = lambda x, n=len(sums): pa.array([x]).take(pa.array(np.zeros(n, dtype=np.int32)))
                    yield pa.RecordBatch.from_arrays([same(where.rsplit("/", 1)[-1]), same(place), same(data.size), first[lo : lo + len(sums)], pa.array(before[part]), pa.array(counts[part]), pa.array(sums, pa.int64())], names=["shard", "place", "bytes", "doc_id", "at", "n_tokens", "ids_crc32"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).where("length > 0")
    place = F.regexp_extract("path", r"part-(\d+)[^/]*$", 1).cast("long")  # names stop sorting by range at 100,000 shards
    return files.select("path", place.alias("place"), "content").mapInArrow(frugal(read, 1), "shard string, place long, bytes long, doc_id long, at long, n_tokens long, ids_crc32 long")


def write_manifest(found: DataFrame, path: str) -> DataFrame:
    """place, shard, first and last (ids that aren't null), nulls, docs, n_ids, bytes: a row for each shard."""
    rows = found.groupBy("place", "shard").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count(F.when(F.col("doc_id").isNull(), 1)).alias("nulls"), F.count("*").alias("docs"), F.sum("n_tokens").alias("n_ids"), F.first("bytes").alias("bytes"))
    rows.write.parquet(f"{path}-manifest")
    return found.sparkSession.read.schema(rows.schema).parquet(f"{path}-manifest")


class Reader:
    """Keyed access to shards from the driver, by ranged reads through Spark's file systems.

    It holds the manifest (a row for each shard) and the heads of the footers it has met, nothing of the documents.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.path, self.jvm, self.conf = path, spark._jvm, spark._jsc.hadoopConfiguration()
        rows = spark.read.parquet(f"{path}-manifest").orderBy("place").toArrow()
        self.names, self.bytes = rows.column("shard").to_pylist(), rows.column("bytes").to_pylist()
        self.nulls = [i for i, n in enumerate(rows.column("nulls").to_pylist()) if n]
        keyed = [i for i, x in enumerate(rows.column("first").to_pylist()) if x is not None]
        self.keyed = np.array(keyed, dtype=np.int64)
        self.first, self.last = (np.array(rows.column(c).take(pa.array(self.keyed)).to_pylist(), dtype=np.int64) for c in ("first", "last"))
        self.layouts: dict[int, tuple[int, Layout]] = {}
        self.reads = 0

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of every row of that document id, in order; none if there is no such row."""
        if doc_id is None:
            shards = self.nulls
        else:
            shards = self.keyed[np.searchsorted(self.last, doc_id) : np.searchsorted(self.first, doc_id, side="right")].tolist()
        return [x for i in shards for x in self._in_shard(i, doc_id)]

    def _in_shard(self, i: int, doc_id: int | None) -> list[np.ndarray]:
        where = self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{self.names[i]}")
        stream = where.getFileSystem(self.conf).open(where)

        def read(at: int, n: int) -> bytes:
            self.reads += 1
            stream.seek(at)
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream, n))

        try:
            if i not in self.layouts:
                end = self.bytes[i] - 1
                size, _ = _TAIL.unpack(read(end - _TAIL.size, _TAIL.size))
                base = end - _TAIL.size - size
                layout = Layout(read(base, _HEAD.size))
                self.layouts[i] = base, layout.sized(read(base + layout.sizes_at, 8 * layout.n_levels) if layout.n_levels else b"")
            base, layout = self.layouts[i]
            out = []
            while (ids := self._ids(read, base, layout, doc_id, len(out))) is not None:
                out.append(ids)
            return out
        finally:
            stream.close()

    @staticmethod
    def _ids(read, base: int, layout: Layout, doc_id: int | None, nth: int) -> np.ndarray | None:
        key = key_hashes(np.array([doc_id or 0]), np.array([nth + (_NULL if doc_id is None else 0)]))
        slot = -1
        for i, size in enumerate(layout.sizes):
            at = _place(key, i, size)
            word, rank = (np.frombuffer(read(base + x + 8 * int(at[0] >> 6), 8), dtype="<u8") for x in (layout.words_at[i], layout.ranks_at[i]))
            slot = int(_found(word, rank, at)[0])
            if slot >= 0:
                break
        if slot < 0 and layout.n_left:  # keys of equal 64 bits
            left = np.frombuffer(read(base + layout.left_at, 8 * layout.n_left), dtype="<u8")
            at = int(np.searchsorted(left, key)[0])
            slot = layout.n - layout.n_left + at if at < len(left) and left[at] == key[0] else -1
        if slot < 0:
            return None
        row = np.frombuffer(read(base + layout.table_at + _SLOT.itemsize * slot, _SLOT.itemsize), dtype=_SLOT)[0]
        if row["print"] != fingerprints(key)[0]:
            return None
        return np.frombuffer(read(int(row["offset"]), int(row["count"]) * layout.width), dtype=f"<u{layout.width}").astype("<u4")


def token_files(docs: DataFrame, tokenizer_path: str, end_id: int = 2, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES, most_broadcast: int = 200_000) -> DataFrame:
    """Write the shards and their manifest, read them back: doc_id, start, n_tokens, ids_crc32, one row for each of ``docs``.

    ``start`` counts the ids of all documents before. Null ids come first and stay null, repeated ids stay apart, other
    columns are ignored, an empty table gives no rows, a null text is the end id alone. Ids are whole
    numbers, or strings of such. What meets in one task to find the starts is one row for each shard.
    """
    spark = docs.sparkSession
    path = path or f"{shared_dir(spark)}/tokens"
    write_shards(docs, path, tokenizer_path, end_id, id_col, text_col, shard_bytes)
    found = materialise(read_shards(spark, path), "found")
    manifest = write_manifest(found, path)
    before = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    starts = manifest.select("place", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("before"))
    starts = F.broadcast(starts) if manifest.count() <= most_broadcast else starts
    return found.join(starts, "place").select("doc_id", (F.col("at") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")

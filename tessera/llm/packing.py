"""Operator 10: packing by first-fit decreasing over a tournament tree, in randomised groups of documents.

A document's ids, with the end id, are cut into full sequences and a rest. Full sequences stand alone. The rests of one
group, longest first, go each to the first sequence with room: leaves of the tree hold the room left in sequences, inner
nodes the most below them, so a place is found in a logarithm of steps. Groups are drawn by a hash of each row's id and
place, hold about ``group_docs`` documents at any size of input and however often an id or a text repeats, and never meet,
so each is packed in memory by one task. The rows' lengths are written down before they are drawn, so that a lost executor
can't move a row to another group.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frugal, materialise
from .encode import encoder

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_PIECES = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])


def first_fit_decreasing(sizes: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each size, given in falling order, none above ``capacity``."""
    leaves = 1 << max(0, len(sizes) - 1).bit_length()
    room = [capacity] * (2 * leaves)
    bins, offsets = [], []
    for size in sizes:
        node = 1
        while node < leaves:
            node *= 2
            if room[node] < size:
                node += 1
        bins.append(node - leaves)
        offsets.append(capacity - room[node])
        room[node] -= size
        node //= 2
        while node:
            most = max(room[2 * node], room[2 * node + 1])
            if room[node] == most:
                break
            room[node] = most
            node //= 2
    return bins, offsets


def cut_documents(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int, cached_pieces: int) -> DataFrame:
    """doc_id, doc_tokens, and the checksum of the ids of each piece: full ones first, then the rest."""

    def encode(batches):
        tool, end = encoder(tokenizer_path, cached_pieces), np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                lengths, sums = [], []
                for ids in tool.encode([x or "" for x in part.column(1).to_pylist()]):
                    ids += end
                    lengths.append(len(ids) // 4)
                    sums.append([zlib.crc32(ids[i : i + 4 * capacity]) for i in range(0, len(ids), 4 * capacity)])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lengths, pa.int64()), pa.array(sums, pa.list_(pa.int64()))], names=["doc_id", "doc_tokens", "sums"])

    return docs.mapInArrow(frugal(encode), "doc_id long, doc_tokens long, sums array<long>")


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 1, capacity: int = 2048, group_docs: int = 16_384, id_col: str = "doc_id", text_col: str = "text", cached_pieces: int = 700_000) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text is the end id alone. Repeated rows are packed each on its own. A null id is kept as null. Ties
    in length go by id, then by the checksums of the ids; the same table, read in the same parts, always gives the same
    sequences. Other columns are ignored. An empty table gives no pieces. A long text is cut like any other. A worker
    keeps the ids of ``cached_pieces`` pieces of text at most. Ids are whole numbers, or strings of such.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    cut = materialise(cut_documents(rows, tokenizer_path, end_id, capacity, cached_pieces).withColumn("row", F.monotonically_increasing_id()), "cut")
    n_groups = max(1, -(-cut.count() // group_docs))
    drawn = F.pmod(F.xxhash64("doc_id", "row"), F.lit(n_groups))

    def place(table: pa.Table) -> pa.Table:
        group = table.column("group")[0].as_py()
        docs_in = sorted(zip(table.column("doc_id").to_pylist(), table.column("doc_tokens").to_pylist(), table.column("sums").to_pylist(), strict=True), key=lambda x: (-(x[1] % capacity), x[0] is None, x[0] or 0, x[1], x[2]))
        rests = [x[1] % capacity for x in docs_in if x[1] % capacity]
        bins, offsets = first_fit_decreasing(rests, capacity)
        full, out = max(bins, default=-1) + 1, []
        for k, (doc_id, n, sums) in enumerate(docs_in):
            for i, crc in enumerate(sums):
                if (length := min(capacity, n - i * capacity)) == capacity:
                    where, offset, full = full, 0, full + 1
                else:
                    where, offset = bins[k], offsets[k]
                out.append((doc_id, i * capacity, length, crc, n, (group << 32) + where, offset))
        return pa.Table.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], schema=_PIECES)

    return cut.withColumn("group", drawn).drop("row").groupBy("group").applyInArrow(place, PIECES)

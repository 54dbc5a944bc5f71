"""Operator 9: chat formatting after cumulative snapshots of one conversation are collapsed.

A log may hold a conversation many times, each time with more turns. A rolling hash over the turns gives the hash of
every prefix. A conversation whose whole is a proper prefix of another is left out by an anti-join; of equal ones the
smallest id stays. What is left is rendered, one text a conversation.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

ROLLED = "conv_id long, n_turns long, whole binary, prefixes array<binary>, text string"


def render(turns: list[tuple[str, str]]) -> str:
    """Each turn as a marked block. A marker inside a turn's own text is broken up, so it can't pose as a turn."""
    return "".join(f"<|{role}|>\n{text.replace('<|', '< |')}\n<|end|>\n" for role, text in turns)


def rolled(conversations: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """One row a conversation, with the hashes of its prefixes and of the whole."""
    rows = conversations.select(F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col), F.lit("unknown")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).where("conv_id IS NOT NULL")
    lists = rows.groupBy("conv_id").agg(F.collect_list(F.struct("turn", "role", "text")).alias("turns"))

    def roll(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part, out = batch.slice(at, 256), []
                for conv_id, turns in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    ordered = sorted({(t["turn"] is not None, t["turn"] or 0, t["role"], t["text"]) for t in turns})
                    chain, hashes = b"", []
                    for _, _, role, text in ordered:
                        r, t = role.encode(), text.encode()
                        chain = hashlib.blake2b(chain + len(r).to_bytes(8, "little") + r + t, digest_size=16).digest()
                        hashes.append(chain)
                    out.append((conv_id, len(hashes), hashes[-1], hashes[:-1], render([(x[2], x[3]) for x in ordered])))
                types = (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.binary()), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names=["conv_id", "n_turns", "whole", "prefixes", "text"])

    return lists.mapInArrow(roll, ROLLED)


def chat_format(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, n_turns, n_copies (conversations equal to this one, itself included), text; maximal conversations only.

    Turns go by number (null first), then role, then text; a repeated row is one turn. A null role is ``unknown``, a
    null text empty. Rows of null id belong to no conversation. Other columns are ignored; no rows give no rows.
    """
    every = materialise(rolled(conversations, id_col, turn_col, role_col, text_col), "rolled")
    heads = every.groupBy("whole").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    shorter = every.select(F.explode("prefixes").alias("whole")).distinct()
    maximal = heads.join(shorter, "whole", "left_anti").select("conv_id", "n_copies")
    return every.join(maximal, "conv_id").select("conv_id", "n_turns", "n_copies", "text")

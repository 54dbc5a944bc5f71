"""Line hashes and line numbers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import as_col, trim_end
from .vectors import let

ANCHOR = r"^(\d+)(?:#([0-9A-Fa-f]{2}))?(?:[│:].*)?$"


def lines_of(text: Column | str) -> Column:
    """Lines, a trailing empty one included."""
    return F.split(as_col(text), "\n", -1)


def normal_line(line: Column) -> Column:
    return trim_end(F.replace(line, F.lit("\r"), F.lit("")))


# The low bytes of the 32-bit FNV-1a offset 0x811C9DC5 and prime 0x01000193.
_OFFSET, _PRIME = 0xC5, 0x93


def _units(line: Column) -> Column:
    """UTF-16 units of a normalised line, as pairs of hex digits of their low bytes."""
    return F.regexp_replace(F.hex(F.encode(normal_line(line), "UTF-16BE")), "..(..)", "$1")


def _folded(units: Column) -> Column:
    """The low byte of a product depends on low bytes alone, so the hash's low byte is a fold over them."""
    codes = F.unhex(units)
    places = F.sequence(F.lit(1), F.octet_length(codes))
    return F.lpad(F.hex(F.aggregate(places, F.lit(_OFFSET), lambda h, i: F.pmod(h.bitwiseXOR(F.ascii(F.decode(F.substring(codes, i, F.lit(1)), "ISO-8859-1"))) * F.lit(_PRIME), F.lit(256)))), 2, "0")


def line_hash(before: Column, line: Column, after: Column) -> Column:
    """Two hex digits over a line and its neighbours (empty at the ends), NUL between them."""
    part = lambda x: _units(F.coalesce(x, F.lit("")))
    return let(F.concat(part(before), F.lit("00"), part(line), F.lit("00"), part(after)), _folded)


def _hash_texts(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
    step = [(x * _PRIME) & 255 for x in range(256)]

    def fold(h: int, units: bytes) -> int:
        for c in units:
            h = step[h ^ c]
        return h

    for texts in it:
        out = []
        for text in texts:
            units = [x.replace("\r", "").rstrip().encode("utf-16-le")[::2] for x in (text or "").split("\n")]
            padded = [b"", *units, b""]
            # the state after a line and a NUL is the same wherever the line stands before another
            after = [step[fold(_OFFSET, x)] for x in padded]
            out.append([f"{fold(step[fold(after[i], x)], padded[i + 2]):02X}" for i, x in enumerate(units)])
        yield pd.Series(out)


def line_hashes(text: Column | str) -> Column:
    """The hash of every line of a text. A fold over characters is slow as an expression, so this is an Arrow function."""
    return F.pandas_udf(_hash_texts, "array<string>")(text)


def anchored(number: Column, digits: Column, mark: Column, line: Column) -> Column:
    return F.concat(F.lpad(number.cast("string"), digits, F.lit(" ")), F.lit("#"), mark, F.lit("│"), line)


def parse_anchor(ref: Column | str) -> Column:
    """Line and hash (upper case, or null) of ``42``, ``42#3F`` or ``42#3F│code``; null where it is none or line 0."""
    core = F.trim(as_col(ref))
    line = F.regexp_extract(core, ANCHOR, 1)
    mark = F.upper(F.regexp_extract(core, ANCHOR, 2))
    ok = core.rlike(ANCHOR) & (F.try_to_number(line, F.lit("9999999999")) >= 1)
    return F.when(ok, F.struct(line.cast("long").alias("line"), F.nullif(mark, F.lit("")).alias("hash")))


def line_span(content: Column, start: Column, length: Column) -> Column:
    """First and last line (from 1) of a piece that starts ``start`` characters in; a line end at its end isn't counted."""
    before = F.size(F.split(F.substr(content, F.lit(1), start), "\n", -1))
    piece = F.substr(content, start + 1, length)
    n = F.size(F.split(piece, "\n", -1)) - F.when(F.endswith(piece, F.lit("\n")), F.lit(1)).otherwise(F.lit(0))
    return F.struct(before.cast("long").alias("first"), (before + F.greatest(n, F.lit(1)) - 1).cast("long").alias("last"))

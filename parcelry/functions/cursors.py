"""Opaque path cursors: URL-safe base64 without padding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def encode_cursor(path: Column) -> Column:
    unbroken = F.regexp_replace(F.base64(path.cast("binary")), r"[\r\n]", "")
    return F.rtrim(F.translate(unbroken, "+/", "-_"), F.lit("="))


def decode_cursor(cursor: Column) -> Column:
    """The path a cursor resumes after, or null when it is malformed.

    Refused: characters outside the alphabet, wrong length or padding, an empty path, a NUL,
    and any component a manifest path cannot have.
    """
    packed = F.regexp_replace(F.translate(cursor, "-_", "+/"), r"[ \t\r\n]", "")
    bare = F.regexp_replace(packed, r"={1,2}$", "")
    padded = F.length(packed) != F.length(bare)
    well_formed = (
        bare.rlike(r"^[A-Za-z0-9+/]+$")
        & (F.length(bare) % 4 != 1)
        & (~padded | (F.length(packed) % 4 == 0))
    )
    filled = F.rpad(bare, (F.ceil(F.length(bare) / 4) * 4).cast("int"), F.lit("="))
    path = F.try_to_binary(F.when(well_formed, filled), F.lit("base64")).cast("string")
    misplaced = F.exists(F.split(path, "/", -1), lambda part: part.isin("", ".", ".."))
    return F.when((path != "") & ~path.contains("\0") & ~misplaced, path)

"""Position lists as base64 of gaps in 7-bit little-endian groups, the high bit meaning that more follow."""

from __future__ import annotations

import base64
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType


def encode_positions(positions: Iterable[int] | None) -> str:
    """Ascending non-negative positions; "" for none."""
    out = bytearray()
    last = 0
    for p in positions if positions is not None else ():
        gap, last = int(p) - last, int(p)
        if gap < 0:
            raise ValueError("positions must be ascending and not negative")
        while True:
            gap, low = gap >> 7, gap & 127
            out.append(low | 128 if gap else low)
            if not gap:
                break
    return base64.b64encode(bytes(out)).decode("ascii")


def decode_positions(text: str | None) -> list[int]:
    """The inverse; bytes of an unfinished number at the end are dropped."""
    found: list[int] = []
    total = value = shift = 0
    for byte in base64.b64decode(text or ""):
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            total += value
            found.append(total)
            value = shift = 0
    return found


@F.pandas_udf(StringType())
def encode_column(positions: pd.Series) -> pd.Series:
    return positions.map(encode_positions)


@F.pandas_udf(ArrayType(IntegerType()))
def decode_column(text: pd.Series) -> pd.Series:
    return text.map(decode_positions)

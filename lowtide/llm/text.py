"""Shared text rules: what a word is, how texts reach numpy, and stable hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word is a run of anything but the six ASCII white-space characters (as bytes.split() has it).
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def text_bytes(column: pa.Array | pa.ChunkedArray) -> Iterator[bytes]:
    """UTF-8 bytes of each text; null counts as empty."""
    for value in column.cast(pa.binary()):
        yield value.as_py() or b""


def signed(values: np.ndarray) -> np.ndarray:
    """64-bit hashes as Spark longs."""
    return values.astype(np.uint64, copy=False).view(np.int64)


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (multiply and shift rounds)."""
    x = values.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x

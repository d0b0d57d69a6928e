"""Tokens: the first half of the 128-bit murmur3 hash (x64, seed 0) of a value's bytes.

Numbers are hashed as eight little-endian bytes, for a whole batch at a time; texts as UTF-8, one by one.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

_MASK = (1 << 64) - 1
# The constants of the hash.
C1, C2 = 0x87C37B91114253D5, 0x4CF5AD432745937F
MIX1, MIX2 = 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53
ADD1, ADD2 = 0x52DCE729, 0x38495AB5


def _turned(x: int, n: int) -> int:
    return (x << n | x >> (64 - n)) & _MASK


def _mixed(x: int) -> int:
    x = (x ^ x >> 33) * MIX1 & _MASK
    x = (x ^ x >> 33) * MIX2 & _MASK
    return x ^ x >> 33


def _spread(k: int, half: int) -> int:
    """Eight bytes of a block as they go into a half of the state."""
    first, turn, second = ((C1, 31, C2), (C2, 33, C1))[half]
    return _turned(k * first & _MASK, turn) * second & _MASK


def murmur3(data: bytes) -> int:
    """As a signed 64-bit integer."""
    a = b = 0
    whole = len(data) // 16 * 16
    for at in range(0, whole, 16):
        a ^= _spread(int.from_bytes(data[at : at + 8], "little"), 0)
        a = ((_turned(a, 27) + b) * 5 + ADD1) & _MASK
        b ^= _spread(int.from_bytes(data[at + 8 : at + 16], "little"), 1)
        b = ((_turned(b, 31) + a) * 5 + ADD2) & _MASK
    a ^= _spread(int.from_bytes(data[whole : whole + 8], "little"), 0)
    b ^= _spread(int.from_bytes(data[whole + 8 :], "little"), 1)
    a, b = a ^ len(data), b ^ len(data)
    a = (a + b) & _MASK
    b = (a + b) & _MASK
    out = (_mixed(a) + _mixed(b)) & _MASK
    return out - (1 << 64) if out >> 63 else out


def of_eight_bytes(values: np.ndarray) -> np.ndarray:
    """murmur3 of each number's bytes."""
    u = np.uint64
    mixed = lambda x: (y := (x ^ (x >> u(33))) * u(MIX1), y := (y ^ (y >> u(33))) * u(MIX2), y ^ (y >> u(33)))[-1]
    k = values.view(np.uint64) * u(C1)
    a = ((k << u(31)) | (k >> u(33))) * u(C2) ^ u(8)
    a = a + u(8)
    return (mixed(a) + mixed(a + u(8))).view(np.int64)


@F.pandas_udf(LongType())
def of_numbers(x: pd.Series) -> pd.Series:
    return _hashed(x, np.int64)


@F.pandas_udf(LongType())
def of_reals(x: pd.Series) -> pd.Series:
    return _hashed(x, np.float64)


def _hashed(x: pd.Series, kind) -> pd.Series:
    there = x.notna().to_numpy()
    out = pd.array([pd.NA] * len(x), dtype="Int64")
    out[there] = of_eight_bytes(x[there].to_numpy(kind))
    return pd.Series(out)


@F.pandas_udf(LongType())
def of_texts(x: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else murmur3(t.encode()) for t in x], dtype="Int64")

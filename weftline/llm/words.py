"""Words of many texts at once, as arrays of hashes."""

from __future__ import annotations

import numpy as np

_STEP = np.uint64(0x100000001B3)


def _table() -> bytes:
    """Lower case; ASCII that is neither letter nor digit becomes a blank; bytes of other characters stay."""
    return bytes(b if b >= 128 else ord(chr(b).lower()) if chr(b).isalnum() else 32 for b in range(256))


TABLE = _table()


def hashed(texts: list[str], stem: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and for each text the number of the first of its words; one more entry ends the last.

    The lower half of a hash is the word's, the upper half that of its first `stem` bytes.
    """
    parts = [t.encode("utf-8", "surrogatepass").translate(TABLE) for t in texts]
    data = np.frombuffer(b" ".join([*parts, b""]), np.uint8)
    begins = np.cumsum([0, *(len(p) + 1 for p in parts)])
    full = data != 32
    edge = np.diff(full.astype(np.int8), prepend=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    at = np.flatnonzero(full)
    inner = at - np.repeat(starts, ends - starts)
    powers = np.cumprod(np.full(int(inner.max()) + 1, _STEP))
    values, cuts = (data[at].astype(np.uint64) + np.uint64(1)) * powers[inner], np.cumsum(np.append(0, (ends - starts)[:-1]))
    word = _mixed(np.add.reduceat(values, cuts))
    begin = _mixed(np.add.reduceat(np.where(inner < stem, values, np.uint64(0)), cuts))
    return (word & np.uint64(0xFFFFFFFF)) | (begin << np.uint64(32)), np.searchsorted(starts, begins)


def _mixed(hashes: np.ndarray) -> np.ndarray:
    hashes ^= hashes >> np.uint64(29)
    hashes *= np.uint64(0xBF58476D1CE4E5B9)
    hashes ^= hashes >> np.uint64(32)
    return hashes

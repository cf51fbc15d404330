"""Words, shingles and their 64-bit hashes over whole Arrow columns, without a Python loop per word."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

# fixed values: the characters that separate words, space and tab to carriage return
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
WORD = r"[^\x20\x09-\x0D]+"

_SPACE = np.zeros(256, bool)
_SPACE[list(SPACES)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_R, _S = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64, kept for the next call."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        p = np.full(max(n, 1 << 16), base, np.uint64)
        p[0] = 1
        have = _powers[base] = np.cumprod(p, dtype=np.uint64)
        if len(have) > 1 << 23:  # made for one very long text
            _powers[base] = have[: 1 << 16].copy()
    return have[:n]


def inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64 bits over 64 bits, one to one."""
    x = x.copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary or string column, and where each row starts in them (one more at the end)."""
    wide = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    kind = np.int64 if wide else np.int32
    at = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[at[0] : at[-1]], at - at[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = 4 << 20):
    """Cut a batch so that the bytes of ``column`` stay below ``limit``, but for single longer rows."""
    at = column_bytes(batch.column(column))[1]
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
        yield batch.slice(i, j - i)
        i = j


class Words:
    """All words of a column of texts: where they are, whose they are, and a hash each."""

    def __init__(self, column: pa.Array, lower: bool = False):
        self.buf, self.at = column_bytes(column)
        buf = _LOWER[self.buf] if lower else self.buf
        self.buf = buf
        n = len(buf)
        word = ~_SPACE[buf]
        edge = np.zeros(n + 1, bool)
        edge[self.at] = True
        before = np.empty(n, bool)
        before[:1] = True
        before[1:] = ~word[:-1]
        after = np.empty(n, bool)
        after[-1:] = True
        after[:-1] = ~word[1:]
        self.start = np.flatnonzero(word & (before | edge[:n]))
        self.end = np.flatnonzero(word & (after | edge[1:])) + 1
        #: the words of row i are first[i] .. first[i + 1] - 1
        self.first = np.searchsorted(self.start, self.at)
        self.row = np.repeat(np.arange(len(self.at) - 1), np.diff(self.first))

    def hashes(self) -> np.ndarray:
        n = len(self.buf)
        if not len(self.start):
            return np.zeros(0, np.uint64)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[self.buf] * powers(_R, n), out=total[1:])
        return mix((total[self.end] - total[self.start]) * powers(inverse(_R), n)[self.start])

    def runs(self, hashes: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = _S) -> np.ndarray:
        """A hash of the words start .. end - 1, for each pair; other than that of any gram of equal words."""
        n = len(hashes)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(hashes * powers(seed, n), out=total[1:])
        return mix((total[end] - total[start]) * powers(inverse(seed), n + 1)[start] + (end - start).astype(np.uint64))

    def grams(self, hashes: np.ndarray, k: int, seed: int = _S) -> tuple[np.ndarray, np.ndarray]:
        """(position of the first word, hash) of every run of ``k`` words inside one row."""
        n = len(hashes)
        if n < k:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(hashes * powers(seed, n), out=total[1:])
        at = np.flatnonzero(self.row[: n - k + 1] == self.row[k - 1 :])
        return at, mix((total[at + k] - total[at]) * powers(inverse(seed), n)[at])

"""Words of many texts as arrays, for use inside Spark tasks.

A word is a longest run of bytes other than space, tab, newline, vertical
tab, form feed and carriage return. Texts arrive as UTF-8 bytes, so code
points above 127 are never split and invalid bytes do no harm.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

U64 = np.uint64
BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
INVERSE = pow(BASE, -1, 1 << 64)
BLOCK_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


BYTE_VALUE = mix(np.arange(1, 257, dtype=U64) * U64(BASE))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U64)
    out[0] = 1
    return np.cumprod(out, dtype=U64)


def chunks(rows: Iterable, size, limit: int = 4 << 20) -> Iterator[list]:
    """Lists of consecutive rows whose sizes sum to about ``limit`` (one row may exceed it)."""
    out, total = [], 0
    for row in rows:
        out.append(row)
        total += size(row)
        if total >= limit:
            yield out
            out, total = [], 0
    if out:
        yield out
    pa.default_memory_pool().release_unused()  # Python workers outlive their tasks


BATCH_KEY, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def small_batches(frame):
    """``frame``, after limiting the Arrow batches of its session to a few MB.

    Texts are long: with the default of 64 MB, each running task holds that
    much in its JVM and in its Python worker, for input and output.
    """
    frame.sparkSession.conf.set(BATCH_KEY, str(BATCH_BYTES))
    return frame


def rows_of(batch, *names: str) -> Iterator[tuple]:
    """The rows of some columns of an Arrow batch, one at a time, so that texts aren't held twice."""
    return zip(*((x.as_py() for x in batch.column(n)) for n in names), strict=True)


class Words:
    """The words of a list of texts, in order.

    ``text``: all words joined by one space, with a space after the last;
    ``offset``: where each word starts in ``text`` (one entry more than words);
    ``first``: index of each text's first word (one entry more than texts).
    """

    def __init__(self, texts: list[bytes | None], lower: bool = False):
        texts = [t or b"" for t in texts]
        raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        if lower:
            raw = LOWER[raw]
        space = SPACE[raw]
        before = np.empty_like(space)
        before[0] = True
        before[1:] = space[:-1]
        start = np.flatnonzero(~space & before)
        end = np.flatnonzero(space & ~before)
        packed = raw[~(space & before)].copy()
        self.offset = np.zeros(len(start) + 1, np.int64)
        np.cumsum(end - start + 1, out=self.offset[1:])
        packed[self.offset[1:] - 1] = 32
        self.bytes = packed
        self.text = packed.tobytes()
        begins = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) + 1 for t in texts], out=begins[1:])
        self.first = np.searchsorted(start, begins)

    def __len__(self) -> int:
        return len(self.offset) - 1

    def slice(self, i: int, j: int) -> bytes:
        """Words i to j (j excluded), joined by one space."""
        return self.text[self.offset[i]:self.offset[j] - 1] if j > i else b""

    def hashes(self, limit: int | None = None) -> np.ndarray:
        """A 64-bit hash of each word (of its first ``limit`` bytes), the same in every task."""
        out = np.empty(len(self), U64)
        i, n = 0, len(self)
        while i < n:
            j = max(i + 1, int(np.searchsorted(self.offset, self.offset[i] + BLOCK_BYTES, "right")) - 1)
            j = min(j, n)
            at = self.offset[i:j + 1] - self.offset[i]
            size = int(at[-1])
            total = np.zeros(size + 1, U64)
            np.cumsum(BYTE_VALUE[self.bytes[self.offset[i]:self.offset[j]]] * _powers(BASE, size), out=total[1:], dtype=U64)
            end = at[1:] - 1 if limit is None else np.minimum(at[1:] - 1, at[:-1] + limit)
            out[i:j] = (total[end] - total[at[:-1]]) * _powers(INVERSE, size)[at[:-1]]
            i = j
        return mix(out)


def rolling(values: np.ndarray, n: int) -> np.ndarray:
    """A hash of each ``n`` consecutive values (a polynomial, as in Karp and Rabin)."""
    size = len(values) - n + 1
    if size <= 0:
        return np.empty(0, U64)
    out = np.zeros(size, U64)
    for j in range(n):
        out = out * U64(BASE) + values[j:j + size]
    return mix(out)

"""What several operators share: Arrow batches, sieves, and hashing of words over whole batches. Lineage is cut by `session`."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, new_path

#: Bytes of text hashed in one numpy step.
STEP = 1 << 18
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of an Arrow batch between Spark and Python; rows are larger only if one text is.
BATCH = 8 << 20
_LIBC: list = []


def small_batches(spark: SparkSession) -> None:
    """Sets the session's Arrow batches to BATCH bytes, unless they are smaller already."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name)
    if not now.rstrip("b").isdigit() or not 0 < int(now.rstrip("b")) <= BATCH:
        spark.conf.set(name, str(BATCH))


def tidied(f):
    """A task's generator that gives its memory back to the system in the end, as Spark keeps the worker."""

    @functools.wraps(f)
    def run(*args, **names):
        try:
            yield from f(*args, **names)
        finally:
            pa.default_memory_pool().release_unused()
            if not _LIBC:
                try:
                    _LIBC.append(ctypes.CDLL("libc.so.6").malloc_trim)
                except (OSError, AttributeError):  # another libc
                    _LIBC.append(lambda _: 0)
            _LIBC[0](0)

    return run


#: Bits of a sieve; its table has at most BITS / 64 rows, whatever the keys.
BITS = 1 << 24


def sieve(df: DataFrame, key: str, among: DataFrame, its: str, flag: str = "maybe") -> DataFrame:
    """df with a column `flag`: true for all rows whose key is among the keys of the other table, and for few others.

    Saves the shuffle of rows that a join would drop. The bits are made by an aggregation and sent to all tasks.
    """
    cell, word, bits = fresh([*df.columns, flag], "cell", "word", "bits")
    bit = lambda c: F.pmod(F.xxhash64(c), F.lit(BITS))
    cells = among.select(bit(F.col(f"`{its}`")).alias("c")).groupBy(F.shiftright("c", 6).alias(word)).agg(F.bit_or(F.expr("shiftleft(1L, cast(c & 63 AS int))")).alias(bits))
    cells = cut(cells, "sieve")
    joined = df.withColumn(cell, bit(F.col(f"`{key}`"))).join(F.broadcast(cells), F.shiftright(cell, 6) == F.col(word), "left")
    hit = F.coalesce(F.expr(f"(`{bits}` & shiftleft(1L, cast(`{cell}` & 63 AS int))) != 0"), F.lit(False))
    return joined.withColumn(flag, hit).drop(cell, word, bits)


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """df without its columns of these names, whatever their case: an operator's outputs replace them."""
    low = {n.lower() for n in names}
    return df.select([F.col(f"`{c}`") for c in df.columns if c.lower() not in low])


def fresh(columns: list[str], *wanted: str) -> list[str]:
    """Names like the wanted ones that no column has, whatever its case."""
    low = {c.lower() for c in columns}
    out = []
    for name in wanted:
        while name.lower() in low:
            name += "_"
        out.append(name)
        low.add(name.lower())
    return out


def utf8(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary Arrow array, null as empty, without a copy of the texts where there is no null."""
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if pa.types.is_null(a.type):
        a = a.cast(pa.string())
    if a.null_count:
        a = a.fill_null(b"" if pa.types.is_binary(a.type) or pa.types.is_large_binary(a.type) else "")
    wide = np.int64 if pa.types.is_large_string(a.type) or pa.types.is_large_binary(a.type) else np.int32
    _, offsets, data = a.buffers()
    if offsets is None or not len(a):
        return np.zeros(0, np.uint8), np.zeros(len(a) + 1, np.int64)
    at = np.frombuffer(offsets, wide)[a.offset : a.offset + len(a) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, at - at[0]


def steps(buf: np.ndarray, at: np.ndarray, most: int = STEP) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs (first, last, bytes, offsets) of whole texts of about `most` bytes; a longer text is a run of its own."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield i, j, buf[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values, the finalizer of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _table(seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(np.arange(1, 257, dtype=np.uint64) * _ODD + np.uint64(seed))


#: A prime; products of two residues and sums of millions of them fit in 64 bits.
PRIME = (1 << 31) - 1


def _residue(x: np.ndarray) -> np.ndarray:
    """x modulo PRIME, or PRIME for 0."""
    x = (x & np.uint64(PRIME)) + (x >> np.uint64(31))
    return (x & np.uint64(PRIME)) + (x >> np.uint64(31))


class Poly:
    """Polynomial hashes of any piece of a buffer out of two running sums.

    One is modulo 2**64, whose odd bases all give equal hashes to some texts of two letters (Thue and Morse's words), the
    other modulo a prime, which does not.
    """

    def __init__(self, seed: int = 1):
        self.values = _table(seed)
        self.base = 0xD6E8FEB86659FD93
        self.inverse = pow(self.base, -1, 1 << 64)
        self.values_p = self.values % np.uint64(PRIME)
        self.base_p = 0x5851F42D % PRIME
        self.inverse_p = pow(self.base_p, -1, PRIME)
        self.up = self.down = self.up_p = self.down_p = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            n = 1 << (n - 1).bit_length()
            for name, b in (("up", self.base), ("down", self.inverse)):
                p = np.full(n, b, np.uint64)
                p[0] = 1
                setattr(self, name, np.multiply.accumulate(p))
            for name, b in (("up_p", self.base_p), ("down_p", self.inverse_p)):
                p = np.ones(1, np.uint64)
                while len(p) < n:
                    p = np.r_[p, p * np.uint64(pow(b, len(p), PRIME)) % np.uint64(PRIME)]
                setattr(self, name, p[:n])

    def sums(self, buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Both running sums."""
        n = len(buf)
        self._powers(n + 1)
        out, out_p = np.zeros(n + 1, np.uint64), np.zeros(n + 1, np.uint64)
        np.cumsum(self.values[buf] * self.up[:n], out=out[1:])
        np.cumsum(_residue(self.values_p[buf] * self.up_p[:n]), out=out_p[1:])
        return out, out_p

    def pieces(self, sums: tuple[np.ndarray, np.ndarray], starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of buf[start:end], with the length mixed in."""
        own, prime = sums
        one = (own[ends] - own[starts]) * self.down[starts]
        two = _residue(_residue(prime[ends] - prime[starts]) * self.down_p[starts]) % np.uint64(PRIME)
        return mix(one + mix(two + _ODD) + (ends - starts).astype(np.uint64) * _ODD)


WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
_KEYS = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def words(buf: np.ndarray, at: np.ndarray, white: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, offsets by text) of the maximal runs of bytes outside `white`; a run ends with its text."""
    inside = np.zeros(len(buf) + 2, bool)
    inside[1:-1] = ~white[buf]
    first = np.zeros(len(buf) + 1, bool)
    first[at] = True
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | first))
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | first))
    return starts, ends, np.searchsorted(starts, at)


def shingles(poly: Poly, buf: np.ndarray, at: np.ndarray, size: int = 5) -> Iterator[np.ndarray]:
    """For each text the sorted distinct 64-bit keys of its windows of `size` words; a shorter text with a word gives one, of all its words.

    A key is 255 less the bytes in its words (0 at least), in the top byte, over 56 bits of hash: ascending keys are
    descending lengths, so roughly ascending frequencies.
    """
    with np.errstate(over="ignore"):
        starts, ends, of = words(buf, at)
        word, long = poly.pieces(poly.sums(buf), starts, ends), ends - starts
        n = len(word) - size + 1
        windows, bytes_ = np.zeros(max(n, 0), np.uint64), np.zeros(max(n, 0), np.int64)
        for k in range(size if n > 0 else 0):
            windows += word[k : k + n] * _KEYS[k]
            bytes_ += long[k : k + n]
        windows = _keyed(windows, bytes_)
        for i in range(len(at) - 1):
            a, b = of[i], of[i + 1]
            if b - a >= size:
                yield np.unique(windows[a : b - size + 1])
            elif b > a:
                whole = np.array([np.sum(word[a:b] * _KEYS[: b - a], dtype=np.uint64) + _KEYS[40] * np.uint64(b - a)], np.uint64)
                yield _keyed(whole, np.array([long[a:b].sum()]))
            else:
                yield np.zeros(0, np.uint64)


def _keyed(hashes: np.ndarray, bytes_: np.ndarray) -> np.ndarray:
    return mix(hashes) >> np.uint64(8) | (255 - np.minimum(bytes_, 255)).astype(np.uint64) << np.uint64(56)

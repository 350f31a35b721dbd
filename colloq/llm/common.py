"""Shared pieces: tables, columns, text buffers, word hashes."""

from __future__ import annotations

import contextlib
import ctypes
import gc

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import clear_scratch, durable, forget, release, scratch_path, scratch_root  # noqa: F401 - for the modules of this folder

#: White space that separates words in every contract of this package.
SPACE = r"[\x20\x09-\x0D]"
NOT_SPACE = r"[^\x20\x09-\x0D]"

_MULT = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x5851F42D4C957F2D  # odd, so that it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Bytes of text that numpy handles at once; a longer text is handled alone.
SLICE_BYTES = 1 << 18


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows and bytes of an Arrow batch that carries whole texts; Spark's own 10,000 rows take tens of MB in each worker and its JVM.
TEXT_ROWS, TEXT_BYTES = 1000, 16 << 20


def text_batches(df: DataFrame) -> DataFrame:
    """``df`` after lowering the session's Arrow batches, for operators that hand whole texts to Python.

    Spark reads these settings when a plan runs, so they have to stay; limits
    that the caller has set lower are kept.
    """
    conf = df.sparkSession.conf
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", TEXT_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", TEXT_BYTES)):
        own = conf.get(name, None)
        if own is None or not own.isdigit() or not 0 < int(own) <= most:
            conf.set(name, str(most))
    return df


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` has it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def own_columns(df: DataFrame) -> list[Column]:
    """The columns of ``df``, whatever characters their names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def numbered(df: DataFrame, name: str) -> DataFrame:
    """``df`` with a stored row id ``name``: an id made anew at each scan may name other rows when files are split otherwise."""
    return durable(df.withColumn(name, F.monotonically_increasing_id()))


#: Bits of the map that keeps rows without a partner from being shuffled; 64 in a row of the table that is broadcast.
MAP_BITS = 1 << 24


def marked(rows: DataFrame, ids: DataFrame, name: str) -> DataFrame:
    """The rows of ``rows`` whose ``name`` (a long) may be in ``ids``; most others go, and nothing of ``rows`` is shuffled.

    Hashes of the ids are marked in a map of MAP_BITS, which is broadcast: rows
    that are not marked have no partner. The map has 262,144 rows of two
    numbers at most and lets through one row in ten without a partner at 1.8
    million ids; an exact join has to follow.
    """
    at = F.pmod(F.xxhash64(F.col(name)), F.lit(MAP_BITS))
    marks = ids.select(at.alias("at")).select(F.shiftright("at", 6).alias("_word"), F.expr("shiftleft(1L, cast(at & 63 AS int))").alias("_bit"))
    marks = durable(marks.groupBy("_word").agg(F.bit_or("_bit").alias("_bits")))
    found = F.getbit(F.col("_bits"), at.bitwiseAND(F.lit(63)).cast("int")) == 1
    return rows.join(F.broadcast(marks), (F.shiftright(at, 6) == F.col("_word")) & found, "left_semi")  # MAP_BITS / 64 rows at most


def those_of(rows: DataFrame, ids: DataFrame, name: str) -> DataFrame:
    """The rows of ``rows`` whose ``name`` (a long) is in ``ids``; most others go before anything is shuffled, whatever the sizes."""
    ids = durable(ids.select(name).distinct())
    return marked(rows, ids, name).join(ids, name, "left_semi")


def lean(run):
    """Arrow function ``run`` that hands freed memory back to the system at a task's end, as workers are used again."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # not every system's C library has it
                ctypes.CDLL(None).malloc_trim(0)

    return wrapped


class Generations(dict):
    """A bounded memo of ``make``: when ``size`` entries are young, they become the old ones, and old ones that were not asked for go."""

    def __init__(self, make, size: int):
        super().__init__()
        self.make, self.size, self.old = make, size, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words with good avalanche (splitmix64's finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * _MULT)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse, for positions below ``n``."""
    if len(_powers[0]) < n:
        n = 1 << (n - 1).bit_length()
        for k, base in enumerate((_BASE, _INVERSE)):
            p = np.ones(n, np.uint64)
            p[1:] = np.uint64(base)
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


def text_slices(texts: pa.Array, most: int = SLICE_BYTES):
    """Yields (first row, bytes, offsets) for runs of rows of about ``most`` bytes; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    width = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offs, data = texts.buffers()
    n = len(texts)
    if not n:
        return
    offs = np.frombuffer(offs, width, n + 1, texts.offset * np.dtype(width).itemsize).astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and offs[-1] else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offs, offs[at] + most, side="right")) - 1)
        end = min(end, n)
        yield at, data[offs[at] : offs[end]], offs[at : end + 1] - offs[at]
        at = end


def words_of(data: np.ndarray, offs: np.ndarray, lower: bool = True):
    """Word hashes, the row of each word, and the words' count by row.

    The hash is a polynomial over bytes modulo 2**64 taken from one running
    sum, with the length mixed in; equal words have equal hashes.
    """
    rows = len(offs) - 1
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(rows, np.int64)
    if lower:
        data = _LOWER[data]
    space = _IS_SPACE[data]
    before = np.empty(n, bool)
    before[0] = True
    before[1:] = space[:-1]
    after = np.empty(n, bool)
    after[-1] = True
    after[:-1] = space[1:]
    edges = offs[:-1][offs[:-1] < n]
    before[edges] = True
    edges = offs[1:][offs[1:] > 0]
    after[edges - 1] = True
    start = np.flatnonzero(before & ~space)
    end = np.flatnonzero(after & ~space) + 1
    up, down = powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE_VALUES[data] * up[:n], out=total[1:])
    h = mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * _MULT)
    bounds = np.searchsorted(start, offs)
    counts = np.diff(bounds)
    return h, np.repeat(np.arange(rows), counts), counts


def shingles_of(h: np.ndarray, counts: np.ndarray, k: int):
    """Hashes of the k-word shingles of each row and their count by row.

    A row with fewer than k words has its whole sequence as its one shingle;
    a row without words has none.
    """
    rows = len(counts)
    many = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    out = np.empty(int(many.sum()), np.uint64)
    first_word = np.concatenate([[0], np.cumsum(counts)])[:-1]
    first = np.concatenate([[0], np.cumsum(many)])[:-1]
    factor = np.uint64(_BASE)
    long_rows = counts >= k
    if long_rows.any():
        rolled = np.zeros(len(h) - k + 1, np.uint64)
        with np.errstate(over="ignore"):
            for j in range(k):
                rolled = rolled * factor + h[j : len(h) - k + 1 + j]
        m = many[long_rows]
        at = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)
        out[np.repeat(first[long_rows], m) + at] = mix(rolled[np.repeat(first_word[long_rows], m) + at] + np.uint64(k))
    for r in np.flatnonzero((counts > 0) & (counts < k)):
        total = 0
        for x in h[first_word[r] : first_word[r] + counts[r]]:
            total = (total * _BASE + int(x)) & 0xFFFFFFFFFFFFFFFF
        out[first[r]] = mix(np.array([(total + int(counts[r])) & 0xFFFFFFFFFFFFFFFF], np.uint64))[0]
    assert rows == len(first)
    return out, many

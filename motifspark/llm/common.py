"""Helpers shared by the training-data operators: tables in the shared folder,
Arrow text buffers, and vectorised 64-bit polynomial hashing of byte ranges."""

from __future__ import annotations

import functools
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

M64 = (1 << 64) - 1


@functools.cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="motifspark-")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; where that is unset, a folder of our own in a single process (as in tests), an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:  # a running session does not let this setting be changed
        if not re.match(r"local(\[[^,\]]*[,\d]*\])?$", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = _own_folder()
    return base.rstrip("/")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage ends here,
    so a lost executor costs a re-read and nothing is computed twice."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column without copying; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def slices(off: np.ndarray, most: int = 1 << 21):
    """Row ranges of about ``most`` bytes each, so numpy temporaries stay small; a longer text goes alone."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Modulus of the polynomial hashes, a prime, and two primitive roots of it: each is the base of one half of a hash.
PRIME = (1 << 31) - 1
_BASES = (1103515245, 1977654935)
_SHIFT, _MASK = np.uint64(31), np.uint64(PRIME)
_BYTES = [1 + mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(m)) % np.uint64(PRIME - 1) for m in (0xD1342543DE82EF95, 0xAF251AF3B0F025B5)]
_powers = [(np.ones(1, np.uint64), np.ones(1, np.uint64)) for _ in _BASES]


def _folded(x: np.ndarray) -> np.ndarray:
    """x modulo PRIME, but for a few multiples of it: under 2**33 for any x."""
    return (x & _MASK) + (x >> _SHIFT)


def _grown(n: int) -> None:
    """Powers of the bases, and of their inverses, up to the n-th at least."""
    size = len(_powers[0][0])
    while size < n:
        for k, base in enumerate(_BASES):
            _powers[k] = tuple(np.concatenate([x, x * np.uint64(pow(b, size, PRIME)) % np.uint64(PRIME)]) for x, b in zip(_powers[k], (base, pow(base, -1, PRIME))))
        size *= 2


class RangeHash:
    """Polynomial hashes, modulo a prime in two bases, of any byte ranges of one buffer: equal bytes give equal values."""

    def __init__(self, data: np.ndarray):
        _grown(len(data) + 1)
        self._sums = []
        for (power, _), value in zip(_powers, _BYTES):
            sums = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(_folded(value[data] * power[: len(data)]), out=sums[1:])
            self._sums.append(sums)

    def _hashed(self, differences, inverses) -> np.ndarray:
        halves = []
        for d, inverse in zip(differences, inverses):
            x = _folded(_folded(_folded(_folded(d)) * inverse))
            halves.append(np.where(x >= _MASK, x - _MASK, x))
        return mix((halves[0] << np.uint64(32)) | halves[1])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return self._hashed((s[end] - s[start] for s in self._sums), (inverse[start] for _, inverse in _powers))

    def grams(self, k: int) -> np.ndarray:
        n = len(self._sums[0]) - k
        return self._hashed((s[k:] - s[:n] for s in self._sums), (inverse[:n] for _, inverse in _powers))


def rows_of(batches):
    """Record batches as they come, empty ones left out; what Arrow keeps for later goes back after the last,
    as workers stay for the next stage's tasks."""
    for b in batches:
        if b.num_rows:
            yield b
    pa.default_memory_pool().release_unused()


def row_key(*columns: str):
    """64-bit key of a row's content, for joins back to the row; repeated rows share it and so share decisions."""
    return F.xxhash64(*columns)

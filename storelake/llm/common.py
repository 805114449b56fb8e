"""Helpers the training-data operators share.

* ``run_dir``      — a fresh folder under the cluster's shared ``spark.checkpoint.dir``.
* ``written``      — cut lineage: write a frame there and read it back, so a lost
                     executor costs a re-read and never a recomputation.
* ``written_bucketed`` — the same, bucketed by a key: later joins and cogroups on
                     that key read the files in place and shuffle only the other side.
* ``ship``         — hand this package to the Python workers.
* ``give_back``, ``giving_back`` — free memory of a Python worker goes back to the system.
* word and shingle hashing over a whole Arrow text column at once (numpy).
"""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import storelake
from storelake.session import checkpoint_dir

# --------------------------------------------------------------------------- shared folder


_shipped: set[str] = set()
# Text rows are large: small Arrow batches bound what a task and its worker hold at once.
_SETTINGS = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}
#: Bytes of text whose words are hashed at once (the arrays behind it take some 30 times as much).
STEP = 512 << 10


def ship(spark: SparkSession) -> None:
    """Give this package to the Python workers (once a Spark application), so that they
    need no copy of their own. Sets what the session leaves unset."""
    sc = spark.sparkContext
    for k, v in _SETTINGS.items():
        if spark.conf.get(k, None) is None:
            spark.conf.set(k, v)
    if sc.applicationId in _shipped:
        return
    top = Path(storelake.__file__).parent
    name = Path(tempfile.mkdtemp(prefix="storelake-")) / "storelake_package.zip"
    with zipfile.ZipFile(name, "w") as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f.relative_to(top.parent))
    sc.addPyFile(str(name))  # Spark's own file service carries it to the executors
    _shipped.add(sc.applicationId)


def give_back() -> None:
    """Spark keeps idle Python workers, and they what they once took: what is free goes back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # a C library without it keeps its memory
        ctypes.CDLL(None).malloc_trim(0)


def giving_back(cogrouped: Callable[[pa.Table, pa.Table], pa.Table]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """``cogrouped``, and ``give_back`` after each group."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        try:
            return cogrouped(left, right)
        finally:
            give_back()

    return run


def run_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder of this run, on the storage every executor sees."""
    ship(spark)
    return f"{checkpoint_dir(spark).rstrip('/')}/storelake-llm/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str, codec: str | None = None) -> DataFrame:
    """Write ``df`` to ``path`` (Parquet, in the session's codec or the one named) and read it back with the same schema."""
    writer = df.write.mode("overwrite")
    (writer.option("compression", codec) if codec else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written_bucketed(df: DataFrame, path: str, *keys: str, codec: str | None = None) -> DataFrame:
    """Write ``df`` as an external table bucketed by ``keys``.

    As many buckets as shuffle partitions: a join, cogroup or aggregate on ``keys`` then takes the
    table's own layout and moves the other side only."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"llm_{uuid.uuid4().hex}"
    writer = df.write.bucketBy(n, *keys).option("path", path).format("parquet")
    (writer.option("compression", codec) if codec else writer).saveAsTable(table)
    return spark.table(table)


def text_of(col: str = "text"):
    """The text column, null as empty."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def packed(docs: DataFrame, **own) -> DataFrame:
    """The rows of ``docs`` as one column ``row`` beside columns of our own, whatever names ``docs`` has.
    ``select("row.*")`` gives them back."""
    return docs.select(F.struct("*").alias("row"), *(c.alias(k) for k, c in own.items()))


# --------------------------------------------------------------------------- Arrow text columns


def plain(column) -> pa.Array:
    """One contiguous large_string array without nulls."""
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(a, pa.ChunkedArray):
        a = pa.concat_arrays(a.chunks) if a.num_chunks else pa.array([], a.type)
    return pc.fill_null(a.cast(pa.large_string()), "")


def buffers(a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and the n+1 offsets of a large_string array (no copy)."""
    _, offs, data = a.buffers()
    o = np.frombuffer(offs, np.int64, len(a) + 1, a.offset * 8) if len(a) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[o[0] : o[-1]], o - o[0]


def slices(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Runs of whole documents of about ``limit`` bytes (one longer document is its own run)."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


# --------------------------------------------------------------------------- words and hashes

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32  # A-Z
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, 9, 10, 11, 12, 13]] = False


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 (a bijection of 64-bit values)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, int(n).bit_length())
    if size not in _POWERS:
        _POWERS.clear()
        with np.errstate(over="ignore"):
            fwd, back = np.full(size, _BASE, np.uint64), np.full(size, _INV, np.uint64)
            fwd[0] = back[0] = 1
            _POWERS[size] = np.multiply.accumulate(fwd), np.multiply.accumulate(back)
    return _POWERS[size]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span data[start:end) (a polynomial hash, mixed with the length)."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    fwd, back = _powers(len(data))
    with np.errstate(over="ignore"):
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + U(1)) * fwd[: len(data)], out=total[1:])
        h = (total[ends] - total[starts]) * back[starts]
        return mix(h + (ends - starts).astype(np.uint64) * U(0xD6E8FEB86659FD93))


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each run values[start:end) of 64-bit hashes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    fwd, back = _powers(len(values))
    with np.errstate(over="ignore"):
        total = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(mix(values) * fwd[: len(values)], out=total[1:])
        return mix((total[ends] - total[starts]) * back[starts] + (ends - starts).astype(np.uint64) * U(0xD6E8FEB86659FD93))


def words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of all words, and each document's range of words."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    m = is_word[data]
    before = np.empty(n, bool)
    before[0], before[1:] = False, m[:-1]
    first = offsets[:-1][offsets[:-1] < n]
    before[first] = False
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, m[1:]
    last = offsets[1:][offsets[1:] > 0] - 1
    after[last] = False
    starts, ends = np.flatnonzero(m & ~before), np.flatnonzero(m & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def shingle_hashes(word: np.ndarray, ranges: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` words that stay inside a document, and each
    document's range of them. A document of 1 to k-1 words has one shingle, its
    whole sequence; one without words has none."""
    n = np.diff(ranges)
    with np.errstate(over="ignore"):
        h = np.zeros(max(0, len(word) - k + 1), np.uint64)
        for j in range(k):
            h = mix(h * U(0x9E3779B97F4A7C15) + word[j : j + len(h)] + U(j + 1))
    count = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
    bounds = np.concatenate([[0], np.cumsum(count)])
    where = np.repeat(ranges[:-1] - bounds[:-1], count) + np.arange(bounds[-1])
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short) == 0:
        return h[where], bounds
    out = np.zeros(bounds[-1], np.uint64)
    inside = np.ones(bounds[-1], bool)
    inside[bounds[short]] = False
    out[inside] = h[where[inside]]
    with np.errstate(over="ignore"):
        for d in short:
            x = np.zeros(1, np.uint64)
            for j, w in enumerate(word[ranges[d] : ranges[d + 1]]):
                x = mix(x * U(0x9E3779B97F4A7C15) + w + U(j + 1))
            out[bounds[d]] = mix(x + U(int(n[d])))[0]
    return out, bounds


def distinct_per_document(h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each document's range."""
    parts = [np.unique(h[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    return (np.concatenate(parts) if parts else h[:0]), np.concatenate([[0], np.cumsum(size)])

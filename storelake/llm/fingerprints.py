"""Document fingerprints: bottom-k sketches of word-shingle hashes.

A fingerprint holds the ``size`` smallest distinct 48-bit hashes of a text's runs of
``k`` words (A-Z lower-cased, words between the six white-space characters), in base64. Fingerprints of the parts of a
text or of several texts merge into that of their union (``merge_sketches``): keep
the smallest of all. From two of them follow estimates of resemblance, of
containment and of the number of distinct shingles.

``edited_pairs`` needs each document beside the next one by descending id. Rows are
dealt by ranges of ids (bounds from quantiles, so no range grows with a key) and sorted;
the first document of a range is also dealt to the range before it, which closes
every seam. One pass over a range keeps the previous document only.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storelake.llm.common import LOWER, NOT_SPACE, STEP, buffers, plain, shingle_hashes, ship, slices, span_hashes, text_of, words

K, SIZE = 5, 128
_BYTES = 6
_FULL = float(1 << 48)

# --------------------------------------------------------------------------- sketches


def sketches(texts: pa.Array, k: int = K, size: int = SIZE) -> list[np.ndarray]:
    """The bottom-k sketch of each text (sorted 48-bit hashes)."""
    data, offsets = buffers(texts)
    out: list[np.ndarray] = []
    for i, j in slices(offsets, STEP):
        low = LOWER[data[offsets[i] : offsets[j]]]
        starts, ends, ranges = words(low, offsets[i : j + 1] - offsets[i], NOT_SPACE)
        h, bounds = shingle_hashes(span_hashes(low, starts, ends), ranges, k)
        h = h >> np.uint64(16)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            mine = h[a:b]
            if len(mine) > 4 * size:  # the smallest hashes are below about this quantile
                few = mine[mine < np.uint64(2 * size / len(mine) * _FULL)]
                few = np.unique(few)
                mine = few if len(few) >= size else np.unique(mine)
            else:
                mine = np.unique(mine)
            out.append(mine[:size])
    return out


def pack(sketch: np.ndarray) -> str:
    """Sketch to text."""
    raw = sketch.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :_BYTES]
    return base64.b64encode(raw.tobytes()).decode()


def unpack(text: str) -> np.ndarray:
    """Text to sketch."""
    raw = np.frombuffer(base64.b64decode(text), np.uint8).reshape(-1, _BYTES)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :_BYTES] = raw
    return out.view("<u8").ravel()


def merge_sketches(a: np.ndarray, b: np.ndarray, size: int = SIZE) -> np.ndarray:
    """Sketch of the union of two shingle sets."""
    return np.union1d(a, b)[:size]


def distinct_shingles(a: np.ndarray, size: int = SIZE) -> float:
    """Estimated number of distinct shingles (exact while the sketch is not full)."""
    return float(len(a)) if len(a) < size else (size - 1) * _FULL / float(a[size - 1])


def resemblance(a: np.ndarray, b: np.ndarray, size: int = SIZE) -> float:
    """Estimated Jaccard similarity; two empty sets are alike, an empty and another are not."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    union = merge_sketches(a, b, size)
    return len(np.intersect1d(np.intersect1d(a, b, assume_unique=True), union, assume_unique=True)) / len(union)


def containment(a: np.ndarray, b: np.ndarray, size: int = SIZE) -> float:
    """Estimated share of a's shingles that b has."""
    if not len(a):
        return 1.0
    return min(1.0, resemblance(a, b, size) * distinct_shingles(merge_sketches(a, b, size), size) / distinct_shingles(a, size))


# --------------------------------------------------------------------------- DataFrames


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, size: int = SIZE) -> DataFrame:
    """``doc_id, fingerprint, n_distinct``: one row per input row. Null texts count as empty; an empty text has an empty fingerprint."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = sketches(plain(batch.column(1)), k, size)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([pack(x) for x in found], pa.string()), pa.array([distinct_shingles(x, size) for x in found], pa.float64())], ["doc_id", "fingerprint", "n_distinct"])

    ship(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(build, "doc_id long, fingerprint string, n_distinct double")


def merged_fingerprints(parts: DataFrame, key: str, size: int = SIZE) -> DataFrame:
    """``key, fingerprint, n_distinct`` of the union of the parts of each key (parts: key, fingerprint).

    Parts are merged by ``size`` smallest of exploded hashes with a windowed rank, so a key
    with very many parts is reduced before it is shuffled."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # merged within the batch first: at most ``size`` hashes a key and batch
            held: dict = {}
            for x, f in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                s = unpack(f or "")
                held[x] = merge_sketches(held[x], s, size) if x in held else s
            keys = [x for x, s in held.items() for _ in range(len(s))]
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field(0).type), pa.array(np.concatenate([*held.values(), np.zeros(0, "<u8")]).astype(np.int64))], [key, "h"])

    ship(parts.sparkSession)
    kind = parts.schema[key].dataType.simpleString()
    hashes = parts.select(key, "fingerprint").mapInArrow(explode, f"{key} {kind}, h long").distinct()
    ranked = hashes.withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy("h"))).where(F.col("r") <= size)
    listed = ranked.groupBy(key).agg(F.sort_array(F.collect_list("h")).alias("hs"))

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.array(x, "<u8") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([pack(x) for x in found], pa.string()), pa.array([distinct_shingles(x, size) for x in found], pa.float64())], [key, "fingerprint", "n_distinct"])

    return listed.mapInArrow(close, f"{key} {kind}, fingerprint string, n_distinct double")


def _compare(k: int, size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "contained_next", "n_distinct"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.float64(), pa.float64()]

    def pairs(ids: list, own: list[str], prints: list[np.ndarray]) -> pa.RecordBatch:
        edited = []
        for text, after in zip(own[:-1], own[1:], strict=True):
            cut = len(text) // 3
            edited.append(text[: len(text) - cut] + after[:cut])
        changed = sketches(plain(pa.array(edited, pa.large_string())), k, size)
        rows = [
            (i, len(t), hashlib.sha256(e.encode()).hexdigest(), pack(a), pack(c), resemblance(a, c, size), resemblance(a, n, size), containment(a, n, size), distinct_shingles(a, size))
            for i, t, e, a, c, n in zip(ids[:-1], own[:-1], edited, prints[:-1], changed, prints[1:], strict=True)
        ]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, prints = [], [], []
        for batch in batches:  # ranges by descending id; each ends with its seam, the head of the next
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                stops = [i + 1 for i, x in enumerate(part.column(2).to_pylist()) if x]
                for i, j in zip([0, *stops], [*stops, part.num_rows], strict=True):
                    column = plain(part.column(1).slice(i, j - i))
                    ids += part.column(0).slice(i, j - i).to_pylist()
                    texts += column.to_pylist()
                    prints += sketches(column, k, size)
                    if len(ids) > 1:
                        yield pairs(ids, texts, prints)
                        ids, texts, prints = ids[-1:], texts[-1:], prints[-1:]
                    if j in stops:
                        ids, texts, prints = [], [], []

    return compare


def edited_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, size: int = SIZE) -> DataFrame:
    """One row per input row: ``doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next, contained_next, n_distinct``.

    The edited text is the document with its last floor(n_chars / 3) code points replaced by
    the first as many (or all) of the next document by descending id; the first follows the
    last. Ties of an id are ordered by text; rows without an id come last. A single document
    is its own next. Null texts count as empty. Empty input, empty result."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = rows.select(F.col("doc_id").cast("double").alias("x")).where("x IS NOT NULL")
    cuts = sorted(set(ids.approxQuantile("x", [i / n for i in range(1, n)], 0.2 / n)), reverse=True) if n > 1 else []
    # the range of a row: how many bounds lie above its id (a binary search over at most n bounds)
    slot = _range_of(F.col("doc_id").cast("double"), cuts)
    placed = rows.select("doc_id", "text", slot.alias("slot"))
    heads = rows.select("doc_id", slot.alias("slot")).groupBy("slot").agg(F.max("doc_id").alias("head"))  # a row a range
    order = Window.orderBy("slot")
    every = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # each range takes the head of the next one; the last takes that of the first
    joints = heads.select("slot", F.lead("slot").over(order).alias("next"), F.first("slot").over(every).alias("first")).select("slot", F.coalesce("next", "first").alias("next"))
    joints = joints.join(heads.select(F.col("slot").alias("next"), "head"), "next").select(F.col("slot").alias("to"), "next", "head")
    seams = placed.join(F.broadcast(joints), (F.col("slot") == F.col("next")) & F.col("doc_id").eqNullSafe(F.col("head")))
    seams = seams.groupBy(F.col("to").alias("slot"), "doc_id").agg(F.min("text").alias("text")).select("doc_id", "text", "slot", F.lit(True).alias("seam"))
    both = placed.withColumn("seam", F.lit(False)).unionByName(seams)
    dealt = both.repartitionById(len(cuts) + 1, F.col("slot").cast("int")).sortWithinPartitions("slot", "seam", F.desc_nulls_last("doc_id"), "text")
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, contained_next double, n_distinct double"
    return dealt.select("doc_id", "text", "seam").mapInArrow(_compare(k, size), schema)


def _range_of(x, cuts: list[float]):
    """Number of the descending bounds ``cuts`` that lie above x; nulls belong to the last range."""

    def search(a: int, b: int):
        if a == b:
            return F.lit(a)
        m = (a + b) // 2
        return F.when(x >= F.lit(cuts[m]), search(a, m)).otherwise(search(m + 1, b))

    return F.when(x.isNull(), F.lit(len(cuts))).otherwise(search(0, len(cuts)))

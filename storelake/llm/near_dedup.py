"""MinHash near-dedup with sequential Bayesian verification.

A document's set is its distinct ``k``-word shingles (words between the six white-space
characters, A-Z lower-cased). Documents whose sets have a Jaccard similarity of at
least ``percent`` per cent are linked; the result is the components of the links.

1. *Sketch.* One pass hashes words and shingles a column at a time and keeps for each
   document the set's size, a 128-bit digest of the set, ``bands`` band keys of ``rows``
   minima each, and one byte of each minimum as signature. With 40 bands of 5 a
   pair at 0.8 shares no band with probability 1e-7.
2. *Copies.* Documents of one digest collapse to the smallest id before any pair
   is formed: thousands of copies make no pairs.
3. *Candidates.* Band keys held by one text only drop out. In every other bucket
   the members are compared with one hub first (a star: as many pairs as members, not
   their square), then, as components grow, only across components: hubs
   change for two more rounds. A last round compares all pairs of a bucket that are
   still in different components, chunk by chunk inside tasks, by signatures and then
   whole sets, and makes rows of links only. So every pair that shares a bucket is in one component
   or has been tested; no cap applies.
4. *Sequential Bayesian verification.* Signatures are compared in batches of ``rows`` * 8. After each
   batch a pair is dropped if the posterior probability (uniform prior) that its similarity
   reaches the threshold is below ``miss``. Survivors are verified on the full sets of their texts.
5. *Components* grow by minimum labels with pointer jumping, written to the
   shared folder after every round.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storelake.llm.common import LOWER, NOT_SPACE, STEP, buffers, distinct_per_document, mix, packed, plain, run_dir, shingle_hashes, slices, span_hashes, text_of, words, written

BANDS, ROWS = 40, 5
STAR_ROUNDS = 3
CHUNK = 500  # members of a bucket that are compared with each other at once
_NAMELESS = 1 << 62
_SKETCH = "doc_id long, text_key long, n_shingles long, digest binary, signature binary, bands array<long>"


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each document, and each document's range."""
    low = LOWER[data]
    starts, ends, ranges = words(low, offsets, NOT_SPACE)
    return distinct_per_document(*shingle_hashes(span_hashes(low, starts, ends), ranges, k))


def minima(h: np.ndarray, bounds: np.ndarray, n: int) -> np.ndarray:
    """``n`` minimum hashes of each document (rows of zeros for empty sets)."""
    out = np.zeros((len(bounds) - 1, n), np.uint64)
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        odd = mix(np.arange(1, n + 1, dtype=np.uint64)) | np.uint64(1)
        with np.errstate(over="ignore"):
            for j in range(n):
                out[full, j] = np.minimum.reduceat(h * odd[j], bounds[:-1][full])
    return out


def _sketch(k: int, bands: int, rows: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(plain(batch.column(2)))
            for i, j in slices(offsets, STEP):
                h, bounds = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], k)
                size = np.diff(bounds)
                least = minima(h, bounds, bands * rows)
                with np.errstate(over="ignore"):
                    key = np.zeros((len(size), bands), np.uint64)
                    grid = least.reshape(len(size), bands, rows)
                    for r in range(rows):
                        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + grid[:, :, r])
                    key = mix(key + np.arange(bands, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
                    sums = [np.concatenate([[np.uint64(0)], np.cumsum(mix(h ^ np.uint64(s)))]) for s in (0x5851F42D4C957F2D, 0x14057B7EF767814F)]
                    digest = np.stack([s[bounds[1:]] - s[bounds[:-1]] for s in sums] + [size.astype(np.uint64)], axis=1)
                signature = (least >> np.uint64(56)).astype(np.uint8) ^ (least >> np.uint64(24)).astype(np.uint8)
                has = size > 0
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, j - i),
                        batch.column(1).slice(i, j - i),
                        pa.array(size),
                        pa.array([d.tobytes() for d in digest], pa.binary()),
                        pa.array([s.tobytes() for s in signature], pa.binary()),
                        pa.array([b if x else [] for b, x in zip(key.view(np.int64).tolist(), has.tolist(), strict=True)], pa.list_(pa.int64())),
                    ],
                    ["doc_id", "text_key", "n_shingles", "digest", "signature", "bands"],
                )

    return sketch


def least_matches(n: int, threshold: float, miss: float) -> int:
    """Fewest matches among ``n`` minima that leave a posterior probability of at least
    ``miss`` for a similarity at or over ``threshold`` (Beta(1, 1) prior)."""
    # P(S >= t | m of n) = P(Binomial(n + 1, t) <= m)
    total = 0.0
    for m in range(n + 1):
        total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if total >= miss:
            return m
    return n


def _prune(n: int, step: int, threshold: float, miss: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    tests = [(a, min(a + step, n)) for a in range(0, n, step)]
    needed = [least_matches(b, threshold, miss) for _, b in tests]

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, n) for c in (2, 3))
            alive, matches = np.arange(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            for (a, b), least in zip(tests, needed, strict=True):
                matches = matches + (x[alive, a:b] == y[alive, a:b]).sum(axis=1)
                alive, matches = alive[matches >= least], matches[matches >= least]
            yield pa.RecordBatch.from_arrays([pc.take(batch.column(c), pa.array(alive)) for c in (0, 1)], ["a", "b"])

    return prune


def _full_sets(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each text's whole shingle set, as sorted 32-bit hashes."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(plain(batch.column(1)))
            for i, j in slices(offsets, STEP):
                h, bounds = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], k)
                small = [np.unique((h[a:b] >> np.uint64(32)).astype("<u4")).tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(small, pa.binary())], ["id", "members"])

    return sets


def _across(n: int, step: int, percent: int, miss: float) -> Callable[[pa.Table], pa.Table]:
    """The links between different labels in one chunk, or between two chunks, of a bucket.

    A pair is looked at in the first bucket it shares. It passes the sequential test on
    signatures, then the comparison of whole sets of 32-bit hashes (two hashes of
    tolerance for collisions: words decide later)."""
    tests = [(a, min(a + step, n)) for a in range(0, n, step)]
    needed = [least_matches(b, percent / 100, miss) for _, b in tests]

    def compare(group: pa.Table) -> pa.Table:
        ids, label, own = (group.column(c).to_numpy() for c in ("id", "label", "own"))
        sig = np.frombuffer(b"".join(group.column("signature").to_pylist()), np.uint8).reshape(-1, n)
        keys = group.column("bands").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        here = int(np.flatnonzero(keys[0] == group.column("band")[0].as_py())[0])
        members = [np.frombuffer(b, "<u4") for b in group.column("members").to_pylist()]
        x, y = group.column("x")[0].as_py(), group.column("y")[0].as_py()
        left, right = np.flatnonzero(own == x), np.flatnonzero(own == y)
        out = []
        for at in range(0, len(left), 64):
            rows = left[at : at + 64]
            i, j = np.nonzero((label[rows][:, None] != label[right][None, :]) & ((ids[rows][:, None] < ids[right][None, :]) | (x != y)))
            i, j = rows[i], right[j]
            matches = np.zeros(len(i), np.int64)
            for (a, b), least in zip(tests, needed, strict=True):
                matches = matches + (sig[i, a:b] == sig[j, a:b]).sum(axis=1)
                alive = matches >= least
                i, j, matches = i[alive], j[alive], matches[alive]
            first = (keys[i] == keys[j]).argmax(axis=1) == here
            for p, q in zip(i[first].tolist(), j[first].tolist(), strict=True):
                both = len(np.intersect1d(members[p], members[q], assume_unique=True)) + 2
                if 100 * both >= percent * (len(members[p]) + len(members[q]) - both):
                    out.append((min(ids[p], ids[q]), max(ids[p], ids[q])))
        return pa.Table.from_arrays([pa.array([c[z] for c in out], pa.int64()) for z in (0, 1)], ["a", "b"])

    return compare


def word_shingles(text: str, k: int) -> set:
    """The full set of a text: runs of ``k`` words, or the whole sequence of a shorter text."""
    low = text.encode().translate(_LOWER)
    said = low.translate(_SPACES).split(b" ")
    said = [w for w in said if w]
    if len(said) < k:
        return {tuple(said)} if said else set()
    return set(zip(*(said[i:] for i in range(k)), strict=False))


_LOWER = bytes(LOWER)
_SPACES = bytes(0x20 if 9 <= i <= 13 else i for i in range(256))


def _verify(k: int, percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, x = None, set()
        for batch in batches:
            keep = []
            for i, (a, s, t) in enumerate(zip(*(batch.column(c).to_pylist() for c in (0, 2, 3)), strict=True)):
                if a != last:
                    last, x = a, word_shingles(s, k)
                y = word_shingles(t, k)
                both = len(x & y)
                if both and 100 * both >= percent * (len(x) + len(y) - both):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([pc.take(batch.column(c), pa.array(keep, pa.int64())) for c in (0, 1)], ["a", "b"])

    return verify


def components(labels: DataFrame, links: DataFrame, path: str) -> DataFrame:
    """(id, label) after the links (a, b) have joined the labels they connect.

    Works on the graph of labels: each keeps the smallest neighbour's label and
    jumps to that label's own, until nothing changes."""
    ends = labels.select(F.col("id").alias("a"), F.col("label").alias("la"))
    other = labels.select(F.col("id").alias("b"), F.col("label").alias("lb"))
    edge = links.join(ends, "a").join(other, "b").where("la <> lb")
    edge = written(edge.select(F.explode(F.array(F.struct(F.col("la").alias("x"), F.col("lb").alias("y")), F.struct(F.col("lb").alias("x"), F.col("la").alias("y"))))).select("col.*").distinct(), f"{path}/edges")
    node = written(edge.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("l")), f"{path}/nodes-0")
    step = 0
    while True:
        step += 1
        by = node.select(F.col("x").alias("y"), F.col("l").alias("ly"))
        near = edge.join(by, "y").groupBy("x").agg(F.min("ly").alias("m"))
        lower = node.join(near, "x").select("x", F.col("l").alias("old"), F.least("l", "m").alias("l"))
        jump = node.select(F.col("x").alias("l"), F.col("l").alias("j"))
        moved = written(lower.join(jump, "l", "left").select("x", "old", F.least("l", F.coalesce("j", "l")).alias("l")), f"{path}/nodes-{step}")
        node = moved.select("x", "l")
        if moved.where("l <> old").isEmpty():
            break
    now = node.select(F.col("x").alias("label"), "l")
    return written(labels.join(now, "label", "left").select("id", F.coalesce("l", "label").alias("label")), f"{path}/labels")


def _id():
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(_NAMELESS) + F.shiftrightunsigned(F.xxhash64(text_of()), 2))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS, miss: float = 1e-6) -> DataFrame:
    """One row per input row: ``doc_id, text_key, n_shingles, component_id, kept``.

    ``component_id`` is the smallest doc_id that links reach (itself included), ``kept``
    says that the row has it. Texts without words are linked with nothing; null
    texts count as empty. A null doc_id stands for an id past all others (from 2 ** 62), made of its
    text, and is null in the result. Rows that repeat an id are one document, each with its
    row; of its texts the smallest is compared. Columns other than doc_id and text are not
    read. Empty input, empty result."""
    spark: SparkSession = docs.sparkSession
    path = run_dir(spark, "near")
    text = docs.select(_id().alias("doc_id"), text_of().alias("text"))
    sketches = written(text.select("doc_id", F.xxhash64("text").alias("text_key"), "text").mapInArrow(_sketch(k, bands, rows), _SKETCH), f"{path}/sketches")

    # one text of each digest stands for its copies
    groups = sketches.where("n_shingles > 0").groupBy("digest").agg(F.min("doc_id").alias("id"), F.first("signature").alias("signature"), F.first("bands").alias("bands"))
    groups = written(groups, f"{path}/texts")
    held = groups.select("id", F.explode("bands").alias("band"))
    shared = held.groupBy("band").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo <> hi").select("band")
    buckets = written(held.join(shared, "band"), f"{path}/buckets")
    labels = written(buckets.select("id").distinct().withColumn("label", F.col("id")), f"{path}/labels")
    signature = written(groups.select("id", "signature").join(labels.select("id"), "id"), f"{path}/signatures")
    wanted = text.join(labels.select(F.col("id").alias("doc_id")), "doc_id", "left_semi")
    texts = written(wanted.groupBy(F.col("doc_id").alias("id")).agg(F.min("text").alias("text")), f"{path}/candidates")

    tested = None
    for turn in range(STAR_ROUNDS + 1):
        now = buckets.join(labels, "id")
        split = now.groupBy("band").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.min(F.struct(F.xxhash64(F.lit(turn), "id") if turn else F.lit(0).cast("long"), "id", "label")).alias("hub")).where("lo <> hi")
        if turn < STAR_ROUNDS:
            member = now.join(split.select("band", "hub.id", "hub.label").toDF("band", "hub", "hub_label"), "band")
            pairs = member.where("label <> hub_label").select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b"))
            pairs = pairs.distinct()
            if tested is not None:
                pairs = pairs.join(tested, ["a", "b"], "left_anti")
            pairs = written(pairs, f"{path}/{turn}/pairs")
            tested = pairs if tested is None else tested.unionAll(pairs)
            x = signature.select(F.col("id").alias("a"), F.col("signature").alias("sa"))
            y = signature.select(F.col("id").alias("b"), F.col("signature").alias("sb"))
            alive = pairs.join(x, "a").join(y, "b").select("a", "b", "sa", "sb").mapInArrow(_prune(bands * rows, rows * 8, percent / 100, miss), "a long, b long")
        else:
            # cut every open bucket into chunks and compare chunk with chunk inside tasks: only links become rows
            open_ = written(now.join(split.select("band"), "band"), f"{path}/open")
            chunks = open_.groupBy("band").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("n"))
            ids = open_.select("id").distinct()
            sets = texts.join(ids, "id", "left_semi").mapInArrow(_full_sets(k), "id long, members binary")
            known = groups.select("id", "signature", "bands").join(sets, "id")
            member = open_.join(chunks, "band").join(known, "id").withColumn("own", F.pmod(F.xxhash64(F.lit(1), "id"), F.col("n")).cast("int"))
            against = member.select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("other"))
            dealt = against.select("band", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "id", "label", "signature", "bands", "members")
            compare = _across(bands * rows, rows * 8, percent, miss)
            alive = dealt.groupBy("band", "x", "y").applyInArrow(compare, "a long, b long").distinct().join(tested, ["a", "b"], "left_anti")
        alive = written(alive, f"{path}/{turn}/alive")
        if alive.isEmpty():
            continue
        s = texts.select(F.col("id").alias("a"), F.col("text").alias("ta"))
        t = texts.select(F.col("id").alias("b"), F.col("text").alias("tb"))
        links = alive.join(t, "b").join(s, "a").select("a", "b", "ta", "tb").mapInArrow(_verify(k, percent), "a long, b long")
        links = written(links, f"{path}/{turn}/links")
        labels = components(labels, links, f"{path}/{turn}")

    of_text = groups.select("digest", "id").join(labels, "id", "left").select("digest", F.coalesce("label", "id").alias("component"))
    found = sketches.select("doc_id", "text_key", "n_shingles", "digest").join(of_text, "digest", "left")
    result = found.withColumn("component", F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id")))
    shown = lambda c: F.when(F.col(c) < _NAMELESS, F.col(c))
    return result.select(shown("doc_id").alias("doc_id"), "text_key", "n_shingles", shown("component").alias("component_id"), (F.col("doc_id") == F.col("component")).alias("kept"))


def keep_one_of_near(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that stay (one of each component), with all their columns."""
    gone = near_duplicates(docs, **options).where("NOT kept").select("doc_id", "text_key").distinct()
    marked = packed(docs, id=F.col("doc_id").cast("long"), key=F.xxhash64(text_of()))
    same = marked["id"].eqNullSafe(gone["doc_id"]) & (marked["key"] == gone["text_key"])
    return marked.join(gone, same, "left_anti").select("row.*")

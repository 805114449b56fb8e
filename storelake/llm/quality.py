"""Quality classifier: an interpolated modified Kneser-Ney model of trusted text.

The model is over characters (runs of ``ORDER`` = 5; each of the five packs
into 12 bits: characters from U+0800 on share 2,048 numbers by a hash). Trusted text is every document labelled
good. A model is too sure of what it was trained on, so trusted documents are split in ``FOLDS`` = 3 by
a hash of their id; a language has a model for each fold that counts the others, and scores the fold's
documents. All other documents get the mean bits of the models.

1. *Blocks.* Documents are stored once in compressed blocks, bucketed by block.
   Labels meet the block's document numbers, so no text is moved for them.
2. *Counts.* Every block gives its distinct n-grams with their counts in trusted
   documents (pre-aggregated); summed over all blocks they are the highest order,
   and distinct-predecessor counts of those are the lower orders.
3. *Discounts* D1, D2, D3+ follow from the counts of counts of each order and language.
4. *Scores.* The corpus's distinct n-grams are looked up by shuffle joins, order by
   order: P(w|h) = (c - D(c)) / c(h) + gamma(h) P(w|h'). The log-probabilities join
   the n-grams of each block, and a block sums them by document.
5. *Thresholds.* Short texts vary more than long ones, with the root of their length up to
   ``FLAT`` characters. So bits are standardised: less the language's median, over sqrt(1 + FLAT / length),
   over the language's median deviation (drawn a little to that of all languages). A
   document is rejected if its score exceeds the ``quantile`` of the trusted
   texts of its language, to which those of all languages are added with a weight of ``least``
   texts in all. The same rule holds at any count. Equal texts count once. What n texts tell is
   uncertain: their median by sqrt(pi / 2 n) deviations, and their median deviation like a deviation
   of 0.37 n normal values, for which Student's t widens the normal quantile z by 1 + (z^2 + 1) / (4 * 0.37 n).
   A language without trusted text has no model and no limit.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storelake.llm.common import buffers, give_back, giving_back, packed, plain, run_dir, slices, text_of, written, written_bucketed

ORDER = 5
FOLDS = 3
LEAST_DISCOUNT = 0.01
BLOCK_BYTES = 64 << 20
LEVEL = 6  # of the compression of blocks
FLAT = 4096  # characters up to which the spread of texts falls with the root of their length
PRIOR = 4  # texts that the spread of all languages counts as beside a language's own
EFFICIENCY = 0.37  # of the median deviation, against the deviation of normal values
STEPS, MOST = 10_000, 100.0  # steps of a quantile; scores beyond MOST count as MOST
_WIDTH = 12  # bits a character
_VOCABULARY = 1 << _WIDTH  # the lowest order backs off to the uniform distribution
_SALTS = 256
_FEW_SALTS = 16
_BITS_STEP, _BITS = 1 << 15, 21  # log-probabilities travel in steps of 2 ** -15, 21 bits a model
_COUNTS = [f"n{k}" for k in range(FOLDS)]
_FAR = 25  # log2 of the bytes back in which a copy is found
_CODEC = "zstd"
_RUNS = 8  # slices whose n-grams are merged at once
_HELD = 1 << 19  # n-grams of a slice
_ROWS = 1 << 16  # of a batch that a worker hands back: the executor holds a batch whole
_PARTS = 4  # partitions of the input that fill blocks together, while every core still has one
_SCORE_STEPS = 100  # steps of a standardised score
_START, _END = 2, 3  # control characters that stand for the edges of a text
_BLOCKS = "block long, doc_ids array<long>, keys array<long>, langs array<string>, sizes array<long>, texts binary"


class _Texts:
    """Documents of one block on their way to a row; their texts are compressed as they come."""

    def __init__(self, packing: zstandard.ZstdCompressionParameters) -> None:
        self.bytes = 0
        self.ids, self.keys, self.langs, self.sizes, self.parts = [], [], [], [], []
        self.packing = zstandard.ZstdCompressor(compression_params=packing).compressobj()

    def add(self, ids: list, keys: list, langs: list, data: np.ndarray, offsets: np.ndarray) -> None:
        self.ids += ids
        self.keys += keys
        self.langs += langs
        self.sizes += np.diff(offsets).tolist()
        self.parts.append(self.packing.compress(data.tobytes()))
        self.bytes += len(data)

    def row(self, number: int) -> pa.RecordBatch:
        texts = b"".join([*self.parts, self.packing.flush()])
        kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.int64()), pa.binary()]
        cells = [number, self.ids, self.keys, self.langs, self.sizes, texts]
        return pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(cells, kinds, strict=True)], ["block", "doc_ids", "keys", "langs", "sizes", "texts"])


def _blocks(block_bytes: int, level: int = 3, far: bool = False) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Texts in compressed blocks; ``far`` also finds copies that lie far apart in a block."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        packing = zstandard.ZstdCompressionParameters.from_level(level, **({"window_log": _FAR, "enable_ldm": True} if far else {}))
        number, block = (context.partitionId() if context else 0) << 32, _Texts(packing)
        for batch in batches:
            data, offsets = buffers(plain(batch.column(3)))
            ids, keys, langs = (batch.column(c).to_pylist() for c in range(3))
            for i, j in slices(offsets, block_bytes // 4):
                block.add(ids[i:j], keys[i:j], langs[i:j], data[offsets[i] : offsets[j]], offsets[i : j + 1])
                if block.bytes >= block_bytes:
                    yield block.row(number)
                    number, block = number + 1, _Texts(packing)
        if block.ids:
            yield block.row(number)
        del block
        give_back()

    return build


def _documents(block: pa.Table) -> tuple[dict, list[bytes]]:
    row, texts = _one_by_one(block)
    return row, list(texts)


def _one_by_one(block: pa.Table) -> tuple[dict, Iterator[bytes]]:
    """The same, but a text is unpacked when it is asked for."""
    row = {c: block.column(c)[0].as_py() for c in ("block", "doc_ids", "keys", "langs", "sizes")}
    texts = zstandard.ZstdDecompressor().stream_reader(block.column("texts")[0].as_buffer())  # no copy
    return row, (texts.read(size) for size in row["sizes"])


def ngrams(text: bytes) -> np.ndarray:
    """The packed character n-grams of a text, one for each character and one for its end."""
    units = np.frombuffer(text.decode("utf-8").encode("utf-32-le"), np.uint32).astype(np.uint64)
    half = _VOCABULARY // 2
    padded = np.full(len(units) + ORDER, _START, np.uint64)
    padded[-1] = _END
    padded[ORDER - 1 : -1] = np.where(units < half, units, half + units * np.uint64(0x9E3779B1) % np.uint64(half - 1))
    out = np.zeros(len(units) + 1, np.uint64)
    for k in range(ORDER):
        out = (out << np.uint64(_WIDTH)) | padded[k : k + len(out)]
    return out.view(np.int64)


def _merged(runs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([r[0] for r in runs])
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(np.concatenate([r[1] for r in runs])[order], first)


def _counted(texts: Iterator[tuple[str, int, bytes]]) -> dict[str, dict[int, tuple[np.ndarray, np.ndarray]]]:
    """By language and fold the distinct n-grams and their counts, from (lang, fold, text).

    N-grams are held until there are ``_HELD`` of them; what is counted is merged a few runs at a time."""
    held: dict[tuple[str, int], list[np.ndarray]] = {}
    runs: dict[tuple[str, int], list[tuple[np.ndarray, np.ndarray]]] = {}
    size = 0

    def count() -> None:
        for of, grams in held.items():
            mine = runs.setdefault(of, [])
            mine.append(np.unique(np.concatenate(grams), return_counts=True))
            if len(mine) == _RUNS:
                mine[:] = [_merged(mine)]
        held.clear()

    for lang, fold, text in texts:
        grams = ngrams(text)
        held.setdefault((lang, fold), []).append(grams)
        size += len(grams)
        if size > _HELD:
            count()
            size = 0
    count()
    out: dict[str, dict[int, tuple[np.ndarray, np.ndarray]]] = {}
    for lang, fold in sorted(runs):
        out.setdefault(lang, {})[fold] = _merged(runs.pop((lang, fold)))
    return out


def _count(block: pa.Table, trusted: pa.Table) -> pa.Table:
    row, texts = _one_by_one(block)
    fold = dict(zip(trusted.column("place").to_pylist(), trusted.column("fold").to_pylist(), strict=True))
    out = []
    for lang, by_fold in _counted((x, fold.get(i, FOLDS), t) for i, (x, t) in enumerate(zip(row["langs"], texts, strict=True))).items():
        mine = np.unique(np.concatenate([keys for keys, _ in by_fold.values()]))
        counts = [np.zeros(len(mine), np.int64) for _ in range(FOLDS)]
        for k in range(FOLDS):
            if k in by_fold:
                seen, times = by_fold[k]
                counts[k][np.searchsorted(mine, seen)] = times
        same = [pa.repeat(pa.scalar(row["block"], pa.int64()), len(mine)), pa.repeat(pa.scalar(lang, pa.string()), len(mine))]
        out.append(pa.Table.from_arrays([*same, pa.array(mine), *map(pa.array, counts)], ["block", "lang", "gram", *_COUNTS]))
    return pa.Table.from_batches(pa.concat_tables(out).to_batches(max_chunksize=_ROWS))


def _score(block: pa.Table, scores: pa.Table) -> pa.Table:
    row, texts = _one_by_one(block)
    lang = scores.column("lang").combine_chunks().dictionary_encode()
    gram, packed = scores.column("gram").to_numpy(), scores.column("bits").to_numpy()
    known = {}
    for k, x in enumerate(lang.dictionary.to_pylist()):
        mine = np.flatnonzero(lang.indices.to_numpy() == k)
        mine = mine[np.argsort(gram[mine])]
        known[x] = gram[mine], packed[mine]
    del lang, gram, packed, mine
    n = len(row["sizes"])
    total, size = np.zeros((n, FOLDS)), np.zeros(n, np.int64)
    for i, (x, text) in enumerate(zip(row["langs"], texts, strict=True)):
        keys, values = known[x]
        found = values[np.searchsorted(keys, ngrams(text))]
        total[i], size[i] = [((found >> (_BITS * k)) & ((1 << _BITS) - 1)).sum() / _BITS_STEP for k in range(FOLDS)], len(found)
    return pa.Table.from_arrays(
        [pa.array(np.full(n, row["block"])), pa.array(np.arange(n), pa.int32()), pa.array(row["doc_ids"], pa.int64()), pa.array(row["keys"], pa.int64()), pa.array(row["langs"], pa.string()), pa.array(size), *(pa.array(total[:, k] / size) for k in range(FOLDS))],
        ["block", "place", "doc_id", "text_key", "lang", "n_grams", *(f"bits{k}" for k in range(FOLDS))],
    )


# --------------------------------------------------------------------------- the model, as tables


def _context(gram):
    return F.shiftrightunsigned(gram, _WIDTH)


def _suffix(gram, order: int):
    return F.col(gram).bitwiseAND(F.lit((1 << (_WIDTH * order)) - 1))


def _of_fold(n: str) -> dict[str, str]:
    return {k: n.replace("n", k, 1) for k in ("d1_", "d2_", "d3_", "own", "rest", "p", "base")}


def _less(n: str):
    """The discount of a count of model ``n`` (d1_, d2_, d3_ by language beside it)."""
    c = _of_fold(n)
    return F.when(F.col(n) == 0, F.lit(0.0)).when(F.col(n) == 1, F.col(c["d1_"])).when(F.col(n) == 2, F.col(c["d2_"])).otherwise(F.col(c["d3_"]))


def _discounted(counts: DataFrame, path: str) -> DataFrame:
    """One order's (lang, gram) with, by model, the discounted share of its context (own) and the weight of the lower order (rest)."""
    found = counts.groupBy("lang").agg(*(F.count_if(F.col(n) == k).alias(f"{n}_{k}") for n in _COUNTS for k in (1, 2, 3, 4)))
    columns = []
    for n in _COUNTS:
        of = [F.col(f"{n}_{k}") for k in (1, 2, 3, 4)]
        y = F.when(of[0] > 0, of[0] / (of[0] + 2 * of[1])).otherwise(F.lit(0.5))
        # where a count of counts is zero the discount is a half; a least discount leaves every context some weight for lower orders
        columns += [F.when(of[k - 1] > 0, F.greatest(F.lit(LEAST_DISCOUNT), F.lit(float(k)) - (k + 1) * y * of[k] / of[k - 1])).otherwise(F.lit(0.5)).alias(_of_fold(n)[f"d{k}_"]) for k in (1, 2, 3)]
    # written, so that Spark knows its size; a language may hold a third of all n-grams: salted, so that no task gets a language whole
    discounts = written(found.select("lang", *columns), path, _CODEC).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(_SALTS - 1).cast("long"))))
    rows = counts.withColumn("salt", F.pmod(F.xxhash64("gram"), F.lit(_SALTS))).join(discounts, ["lang", "salt"])
    of_context = Window.partitionBy("lang", "context")  # at most _VOCABULARY rows
    out = []
    for n in _COUNTS:
        c, total = _of_fold(n), F.sum(n).over(of_context)
        known = total > 0
        out.append(F.when(known, (F.col(n) - _less(n)) / total).otherwise(F.lit(0.0)).cast("float").alias(c["own"]))
        out.append(F.when(known, F.sum(_less(n)).over(of_context) / total).otherwise(F.lit(1.0)).cast("float").alias(c["rest"]))
    return rows.withColumn("context", _context("gram")).select("lang", "gram", *out)


def probabilities(grams: DataFrame, path: str) -> DataFrame:
    """(lang, gram, bits) of every n-gram of the corpus, from (lang, gram, counts by model): log-probabilities of all models in one number."""
    counts = {ORDER: grams}
    for order in range(ORDER - 1, 0, -1):  # a lower order counts the distinct characters before it
        counts[order] = written(counts[order + 1].groupBy("lang", _suffix("gram", order).alias("gram")).agg(*(F.count_if(F.col(n) > 0).alias(n) for n in _COUNTS)), f"{path}/count-{order}", _CODEC)
    lower = None
    for order in range(1, ORDER + 1):
        rows = _discounted(counts[order], f"{path}/discounts-{order}")
        if lower is None:
            base = {n: F.lit(1.0 / _VOCABULARY) for n in _COUNTS}
        else:
            below = lower.select("lang", F.col("gram").alias("shorter"), *(F.col(_of_fold(n)["p"]).alias(_of_fold(n)["base"]) for n in _COUNTS))
            rows = rows.withColumn("shorter", _suffix("gram", order - 1)).join(below, ["lang", "shorter"])
            base = {n: F.col(_of_fold(n)["base"]) for n in _COUNTS}
        ps = {n: F.col(_of_fold(n)["own"]) + F.col(_of_fold(n)["rest"]) * base[n] for n in _COUNTS}
        if order < ORDER:
            lower = written(rows.select("lang", "gram", *(p.cast("float").alias(_of_fold(n)["p"]) for n, p in ps.items())), f"{path}/p-{order}", _CODEC)
    packed = F.lit(0).cast("long")
    for k, n in enumerate(_COUNTS):
        step = F.least(F.round(-F.log2(ps[n]) * _BITS_STEP).cast("long"), F.lit((1 << _BITS) - 1).cast("long"))
        packed = packed.bitwiseOR(F.shiftleft(step, _BITS * k))
    return rows.select("lang", "gram", packed.alias("bits"))


def _quantiles(rows: DataFrame, by: list[str], quantile: float, value, name: str) -> DataFrame:
    """Quantile of ``value`` over rows of weight ``weight``, in steps of 1/STEPS, from sums by step (bounded by the steps)."""
    so_far = Window.partitionBy(*by).orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    step = F.ceil(F.least(F.greatest(value, F.lit(-MOST)), F.lit(MOST)) * STEPS).alias("step")
    steps = rows.groupBy(*by, step).agg(F.sum("weight").alias("weight")).withColumn("upto", F.sum("weight").over(so_far))
    total = rows.groupBy(*by).agg(F.sum("weight").alias(f"{name}_weight"))
    enough = F.col("upto") >= F.col(f"{name}_weight") * F.lit(quantile) - F.lit(1e-6)
    return steps.join(total, by).where(enough).groupBy(*by).agg((F.min("step") / STEPS).alias(name), F.max(f"{name}_weight").alias(f"{name}_weight"))


def _widening():
    """How much wider a text of ``n_grams`` characters may vary than a very long one."""
    return F.sqrt(1 + F.lit(float(FLAT)) / F.col("n_grams"))


def _by_language_of(rows: DataFrame, each: DataFrame) -> DataFrame:
    """``rows`` joined with the row of their language in ``each``, salted so that no task gets a language whole."""
    salt = F.explode(F.sequence(F.lit(0), F.lit(_FEW_SALTS - 1)))
    spread = rows.withColumn("salt", F.pmod(F.xxhash64("n_grams", "bits"), F.lit(_FEW_SALTS)).cast("int"))
    return spread.join(each.withColumn("salt", salt), ["lang", "salt"], "left").drop("salt")


def _tops(pooled: list[tuple[int, float]], quantile: float) -> Callable[[pa.Table], pa.Table]:
    """(lang, top) of a language's sums by step, with the pooled ones added."""
    steps, weights = np.array([s for s, _ in pooled], np.int64), np.array([w for _, w in pooled])

    def top(own: pa.Table) -> pa.Table:
        at = np.concatenate([own.column("step").to_numpy(), steps])
        weight = np.concatenate([own.column("weight").to_numpy(), weights])
        order = np.argsort(at, kind="stable")
        upto = np.cumsum(weight[order])
        first = min(int(np.searchsorted(upto, upto[-1] * quantile - 1e-6)), len(at) - 1)
        return pa.table({"lang": own.column("lang").slice(0, 1), "top": pa.array([at[order][first] / _SCORE_STEPS])})

    return top


def limits(trusted: DataFrame, quantile: float, least: int, path: str) -> DataFrame:
    """(lang, middle, width): a document goes if its bits exceed middle + width * widening.

    ``trusted`` has lang, n_grams, bits of trusted texts. What is collected is one row and the sums of
    all languages by score step, at most 2 * MOST * _SCORE_STEPS rows."""
    trusted = trusted.select("lang", "n_grams", "bits", F.lit(1.0).alias("weight"), F.lit(0).alias("one"))
    middle = written(_quantiles(trusted, ["lang"], 0.5, F.col("bits"), "middle").select("lang", "middle"), f"{path}/middle")
    off = _by_language_of(trusted, middle).withColumn("off", (F.col("bits") - F.col("middle")) / _widening())
    own = _quantiles(off, ["lang"], 0.5, F.abs("off"), "own")
    pool = _quantiles(off, ["one"], 0.5, F.abs("off"), "whole").first()
    whole, total = (pool["whole"], pool["whole_weight"]) if pool else (0.0, 1.0)
    n = F.col("own_weight")
    spread = own.select("lang", n.alias("n"), F.greatest((n * F.col("own") + F.lit(PRIOR * whole)) / (n + PRIOR), F.lit(1 / STEPS)).alias("spread"))
    spread = written(spread, f"{path}/spread")
    # sums by step, of the language itself and (as ``least`` texts in all) of every language
    step = F.round(F.least(F.greatest(F.col("off") / F.col("spread"), F.lit(-MOST)), F.lit(MOST)) * _SCORE_STEPS).cast("long").alias("step")
    scores = written(_by_language_of(off, spread).groupBy("lang", step).agg(F.sum("weight").alias("weight")), f"{path}/by-score")
    pooled = scores.groupBy("step").agg(F.sum("weight").alias("weight")).collect()
    top = scores.groupBy("lang").applyInArrow(_tops([(r.step, r.weight * least / total) for r in pooled], quantile), "lang string, top double")
    z = NormalDist().inv_cdf(quantile)
    doubt = F.sqrt(1 + F.lit(math.pi / 2) / F.col("n")) * (1 + F.lit((z * z + 1) / (4 * EFFICIENCY)) / (F.col("n") + PRIOR))
    width = F.col("spread") * F.greatest("top", F.lit(0.0)) * doubt
    return written(middle.join(spread, "lang").join(top, "lang").select("lang", "middle", width.alias("width")), f"{path}/limits")


def quality_scores(docs: DataFrame, labels: DataFrame, quantile: float = 0.995, least: int = 200, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per input row: ``doc_id, text_key, lang, n_grams, bits, perplexity,
    threshold, fold, kept``.

    ``docs`` needs doc_id, text, lang; ``labels`` doc_id, quality. A null language is a
    language of its own ('und'); a null or empty text is scored by its end alone and
    kept or rejected like any other. A document is trusted if all its labels say 1;
    ``fold`` is then the number of the model that did not count it, else null. ``text_key`` is
    the 64-bit hash of the text, so that (doc_id, text_key) names a row where ids repeat. Empty
    documents give an empty result; without labels everything is kept."""
    spark = docs.sparkSession
    path = run_dir(spark, "quality")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang")).select("doc_id", F.xxhash64("text").alias("text_key"), "lang", "text")
    rows = rows.coalesce(max(spark.sparkContext.defaultParallelism, -(-rows.rdd.getNumPartitions() // _PARTS)))  # no shuffle
    blocks = written_bucketed(rows.mapInArrow(_blocks(block_bytes, LEVEL, far=True), _BLOCKS), f"{path}/blocks", "block", codec=_CODEC)  # a stream: the session's codec may take buffers of a whole block beside the heap, and keep them
    good = labels.groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality = 1").select(F.col("doc_id").cast("long").alias("doc_id"))
    places = blocks.select("block", F.posexplode("doc_ids").alias("place", "doc_id"))
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int")
    trusted = written(places.join(good, "doc_id").select("block", "place", fold.alias("fold")), f"{path}/trusted")
    texts = blocks.select("block", "doc_ids", "keys", "langs", "sizes", "texts")
    kinds = ", ".join(f"{n} long" for n in _COUNTS)
    seen = texts.groupBy("block").cogroup(trusted.groupBy("block")).applyInArrow(giving_back(_count), f"block long, lang string, gram long, {kinds}")
    # shuffled once: the counts and the look-up of probabilities both read the buckets in place
    seen = written_bucketed(seen.repartition("lang", "gram"), f"{path}/grams", "lang", "gram", codec=_CODEC)
    by_fold = seen.groupBy("lang", "gram").agg(*(F.sum(n).alias(n) for n in _COUNTS))
    whole = sum((F.col(n) for n in _COUNTS[1:]), F.col(_COUNTS[0]))
    grams = written(by_fold.select("lang", "gram", *((whole - F.col(n)).alias(n) for n in _COUNTS)), f"{path}/distinct", _CODEC)
    scores = seen.select("block", "lang", "gram").join(probabilities(grams, path), ["lang", "gram"]).select("block", "lang", "gram", "bits")
    models = [f"bits{k}" for k in range(FOLDS)]
    schema = "block long, place int, doc_id long, text_key long, lang string, n_grams long, " + ", ".join(f"{m} double" for m in models)
    scored = texts.groupBy("block").cogroup(scores.groupBy("block")).applyInArrow(giving_back(_score), schema)
    scored = written(scored, f"{path}/scores")
    # a trusted document is scored by the model that did not count it
    mine = F.coalesce(*(F.when(F.col("fold") == k, F.col(m)) for k, m in enumerate(models)), sum((F.col(m) for m in models[1:]), F.col(models[0])) / FOLDS)
    marked = scored.join(trusted, ["block", "place"], "left").withColumn("bits", mine)
    told = written(marked.where("fold IS NOT NULL").dropDuplicates(["lang", "text_key"]).select("lang", "n_grams", "bits"), f"{path}/told")
    threshold = F.col("middle") + F.col("width") * _widening()
    kept = threshold.isNull() | (F.col("bits") <= threshold)
    found = _by_language_of(marked, limits(told, quantile, least, path))
    return found.select("doc_id", "text_key", "lang", "n_grams", "bits", F.pow(F.lit(2.0), "bits").alias("perplexity"), threshold.alias("threshold"), "fold", kept.alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, with all their columns.

    Null, empty and repeated rows, null ids and empty tables are treated as in ``quality_scores``; a row goes with all
    rows that share its id and text. Extra columns stay, whatever their names."""
    bad = quality_scores(docs, labels, **options).where("NOT kept").select("doc_id", "text_key").distinct()
    marked = packed(docs, id=F.col("doc_id").cast("long"), key=F.xxhash64(text_of()))
    same = marked["id"].eqNullSafe(bad["doc_id"]) & (marked["key"] == bad["text_key"])
    return marked.join(bad, same, "left_anti").select("row.*")

"""Toxicity: class-conditional Kneser-Ney models of toxic and of ordinary documents.

Words are runs of letters (ASCII letters and everything beyond ASCII), lower-cased; a word is spelt by its
UTF-8 bytes between a start and an end mark. The models give each byte a probability after up to
``ORDER`` - 1 = 5 bytes of its word.

1. *Blocks.* Documents are stored once in compressed blocks; a block gives its distinct n-grams with
   their counts in all documents and, for the documents that may be learnt from, by class and fold.
2. *Shared counts.* Interpolated modified Kneser-Ney probabilities of the lower orders come from the
   continuation counts of all documents, whatever their label.
3. *Classes.* The highest order is counted by class, discounted, and backs off to the shared
   probabilities, which also count as ``SHARED`` = 5 bytes seen after every context:
   P(w|h) = (c(hw) - D + (SHARED + cut(h)) P(w|h')) / (c(h) + SHARED). So an expression that both
   classes know too little of is about as likely in both.
4. *Scores.* A word's log-likelihood ratio is the sum of its bytes' (in steps of 1/32 bit). What a
   word has above ``MARGIN`` = 4 bits counts; the sum is divided by the number of words and
   ``PSEUDO`` = 20 more, so that a long document needs as large a share of such words as a short one.
5. *Calibration.* Each document that was learnt from is scored by the model without its fold (one of
   four). A logistic curve of these scores, fitted on their counts by step and class,
   turns every document's score into a probability.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storelake.llm.common import LOWER, run_dir, text_of, words, written, written_bucketed
from storelake.llm.quality import _BLOCKS, _blocks, _documents

ORDER = 6
SHARED = 5.0
MARGIN = 4.0
PSEUDO = 20
FOLDS = 4
LEAST_DISCOUNT = 0.01
BLOCK_BYTES = 16 << 20
_STEP = 32  # steps of a bit
_HALF = 2048  # twelve bits hold a ratio of up to 64 bits either way
_BIN = 16  # calibration: steps of a doubling
_FLOOR = 2.0**-8  # bits a word that count as none
_SLICE = 512 << 10
_START, _END = 2, 3
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_CELLS = [f"{c}{k}" for c in "to" for k in range(1, FOLDS + 1)]  # toxic and ordinary counts by fold


def ngrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The packed n-grams of every byte and end of every word, the first n-gram of each word (with an
    end), and each document's range of words."""
    starts, ends, ranges = words(data, offsets, _LETTER)
    size = ends - starts + 2
    at = np.concatenate([[0], np.cumsum(size)])
    stream = np.zeros(at[-1], np.uint64)
    inside = np.arange(at[-1]) - np.repeat(at[:-1], size)  # place in the word; 0 is its start mark
    stream[at[:-1]], stream[at[1:] - 1] = _START, _END
    body = (inside > 0) & (inside < np.repeat(size, size) - 1)
    stream[body] = LOWER[data[(np.repeat(starts, size) + inside - 1)[body]]]
    gram = stream.copy()
    for k in range(1, min(ORDER, len(stream))):
        gram[k:] |= np.where(inside[k:] >= k, stream[:-k], np.uint64(0)) << np.uint64(8 * k)
    return gram[inside > 0].view(np.int64), at - np.arange(len(at)), ranges


def _column(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)


def _slices(texts: list[bytes], places: list[int]):
    """Places of about ``_SLICE`` bytes of text together."""
    held, size = [], 0
    for i in places:
        held.append(i)
        size += len(texts[i])
        if size >= _SLICE:
            yield held
            held, size = [], 0
    if held:
        yield held


def _counted(texts: list[bytes], places: list[int]) -> tuple[np.ndarray, np.ndarray]:
    runs = [np.unique(ngrams(*_column([texts[i] for i in part]))[0], return_counts=True) for part in _slices(texts, places)]
    if not runs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    keys, back = np.unique(np.concatenate([r[0] for r in runs]), return_inverse=True)
    return keys, np.bincount(back, np.concatenate([r[1] for r in runs]), len(keys)).astype(np.int64)


def _count(block: pa.Table, cells: pa.Table) -> pa.Table:
    row, texts = _documents(block)
    cell = dict(zip(cells.column("place").to_pylist(), cells.column("cell").to_pylist(), strict=True))
    groups: list[list[int]] = [[] for _ in range(len(_CELLS) + 1)]
    for i in range(len(texts)):
        groups[cell.get(i, 0)].append(i)
    counted = [_counted(texts, places) for places in groups]
    mine = np.unique(np.concatenate([k for k, _ in counted]))
    columns = []
    for keys, times in counted:
        n = np.zeros(len(mine), np.int64)
        n[np.searchsorted(mine, keys)] = times
        columns.append(n)
    columns = [sum(columns), *columns[1:]]
    return pa.Table.from_arrays([pa.array(np.full(len(mine), row["block"])), pa.array(mine), *map(pa.array, columns)], ["block", "gram", "n", *_CELLS])


def excess(gram: np.ndarray, at: np.ndarray, ranges: np.ndarray, keys: np.ndarray, ratio: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each document: what its words have above the margin (steps), and its words."""
    n = np.diff(ranges)
    if not len(gram):
        return np.zeros(len(n), np.int64), n
    each = np.add.reduceat(ratio[np.searchsorted(keys, gram)], at[:-1])
    total = np.concatenate([[0], np.cumsum(np.maximum(each - int(MARGIN * _STEP), 0))])
    return total[ranges[1:]] - total[ranges[:-1]], n


def _score(block: pa.Table, given: pa.Table) -> pa.Table:
    row, texts = _documents(block)
    gram, value = given.column("gram").to_numpy(), given.column("value").to_numpy()
    cell = dict(zip((-1 - gram[gram < 0]).tolist(), value[gram < 0].tolist(), strict=True))
    value = value[gram >= 0][np.argsort(gram[gram >= 0])]
    keys = np.sort(gram[gram >= 0])
    model = [(cell.get(i, 0) + FOLDS - 1) % FOLDS + 1 if cell.get(i, 0) else 0 for i in range(len(texts))]
    bits, size = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
    for k in range(FOLDS + 1):
        ratio = ((value >> (12 * k)) & 4095) - _HALF
        for part in _slices(texts, [i for i in range(len(texts)) if model[i] == k]):
            over, n = excess(*ngrams(*_column([texts[i] for i in part])), keys, ratio)
            bits[part], size[part] = over / _STEP / (n + PSEUDO), n
    cells = pa.array([cell.get(i, 0) for i in range(len(texts))], pa.int32())
    return pa.Table.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(row["keys"], pa.int64()), cells, pa.array(size), pa.array(bits)], ["doc_id", "text_key", "cell", "n_words", "bits"])


# --------------------------------------------------------------------------- the models, as tables


def _context(gram):
    return F.shiftrightunsigned(gram, 8)


def _discounts(counts: DataFrame, column: str) -> list[float]:
    """The discounts of counts of 1, 2 and 3 or more, from the counts of counts."""
    row = counts.agg(*(F.count_if(F.col(column) == k).alias(f"n{k}") for k in range(1, 5))).first()
    n = [row[f"n{k}"] for k in range(1, 5)]
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
    return [max(LEAST_DISCOUNT, k - (k + 1) * y * n[k] / n[k - 1]) if n[k - 1] else 0.5 for k in (1, 2, 3)]


def _less(n, cut: list[float]):
    return F.when(n <= 0, F.lit(0.0)).when(n == 1, F.lit(cut[0])).when(n == 2, F.lit(cut[1])).otherwise(F.lit(cut[2]))


def shared_probabilities(grams: DataFrame, path: str) -> DataFrame:
    """(gram, p) of every suffix of ORDER - 1 bytes of ``grams`` (gram, n) under the shared model."""
    suffix = lambda order: F.col("gram").bitwiseAND(F.lit((1 << (8 * order)) - 1)).alias("gram")
    counts = {ORDER: grams}
    for order in range(ORDER - 1, 0, -1):  # a lower order counts the distinct bytes before it
        counts[order] = written(counts[order + 1].groupBy(suffix(order)).agg(F.count("*").alias("n")), f"{path}/count-{order}")
    lower = None
    for order in range(1, ORDER):
        cut = _discounts(counts[order], "n")
        rows = counts[order].withColumn("context", _context("gram"))
        less = _less(F.col("n"), cut)
        of = rows.groupBy("context").agg(F.sum("n").alias("total"), F.sum(less).alias("cut"))
        rows = rows.join(of, "context")
        base = F.lit(1 / 256)
        if lower is not None:
            rows = rows.withColumn("shorter", F.col("gram").bitwiseAND(F.lit((1 << (8 * (order - 1))) - 1))).join(lower.select(F.col("gram").alias("shorter"), F.col("p").alias("base")), "shorter")
            base = F.col("base")
        lower = written(rows.select("gram", ((F.col("n") - less + F.col("cut") * base) / F.col("total")).alias("p")), f"{path}/p-{order}")
    return lower


def ratios(grams: DataFrame, path: str) -> DataFrame:
    """(gram, value): the log-likelihood ratios of toxic to ordinary, of the whole model and of those without
    each fold, in steps of 1/32 bit, twelve bits each."""
    lower = shared_probabilities(grams.select("gram", "n"), path)
    rows = grams.withColumn("context", _context("gram"))
    whole = {c: sum((F.col(f"{c}{k}") for k in range(2, FOLDS + 1)), F.col(f"{c}1")) for c in "to"}
    seen = {(c, k): whole[c] - F.col(f"{c}{k}") if k else whole[c] for c in "to" for k in range(FOLDS + 1)}
    cut = {c: _discounts(grams.select(whole[c].alias("n")), "n") for c in "to"}
    sums = [F.sum(x).alias(f"{name}_{c}{k}") for (c, k), n in seen.items() for name, x in (("total", n), ("cut", _less(n, cut[c])))]
    # contexts of n-grams that some class has; of others there is nothing to add up
    contexts = written(rows.groupBy("context").agg(*sums), f"{path}/contexts")
    rows = rows.join(contexts, "context").withColumn("shorter", F.col("gram").bitwiseAND(F.lit((1 << (8 * (ORDER - 1))) - 1)))
    rows = rows.join(lower.select(F.col("gram").alias("shorter"), "p"), "shorter")

    def p(c: str, k: int):
        n = seen[c, k]
        return (n - _less(n, cut[c]) + (F.lit(SHARED) + F.col(f"cut_{c}{k}")) * F.col("p")) / (F.col(f"total_{c}{k}") + F.lit(SHARED))

    value = F.lit(0).cast("long")
    for k in range(FOLDS + 1):
        step = F.round(F.log2(p("t", k) / p("o", k)) * _STEP).cast("long") + _HALF
        value = value.bitwiseOR(F.shiftleft(F.greatest(F.least(step, F.lit(2 * _HALF - 1)), F.lit(0)), 12 * k))
    return rows.select("gram", value.alias("value"))


def fitted_curve(counts: list[tuple[float, int, int]]) -> tuple[float, float]:
    """Intercept and slope (>= 0) of a logistic curve over (x, ordinary, toxic) counts; one count of
    each class at the mean keeps them finite."""
    x, no, nt = (np.array(c, float) for c in zip(*counts, strict=True)) if counts else (np.zeros(0),) * 3
    prior = math.log((nt.sum() + 0.5) / (no.sum() + 0.5))
    if not nt.sum() or not no.sum():
        return prior, 0.0
    middle = float((x * (no + nt)).sum() / (no + nt).sum())
    a, b = prior, 0.0
    x = x - middle
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a + b * x, -500, 500)))
        w = (no + nt) * p * (1 - p)
        gradient = np.array([(nt - (no + nt) * p).sum(), ((nt - (no + nt) * p) * x).sum() - 1e-3 * b])
        curvature = np.array([[w.sum() + 1e-9, (w * x).sum()], [(w * x).sum(), (w * x * x).sum() + 1e-3]])
        step = np.linalg.solve(curvature, gradient)
        step *= min(1.0, 4 / max(np.abs(step).max(), 1e-12))
        a, b = a + step[0], b + step[1]
        if np.abs(step).max() < 1e-9:
            break
    if b < 0:
        return prior, 0.0
    return a - b * middle, b


def toxicity_scores(docs: DataFrame, labels: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per input row: ``doc_id, text_key, held_out, n_words, bits, score, predicted``.

    ``docs`` needs doc_id, text; ``labels`` doc_id, toxic. A document is held out if crc32(doc_id as text) mod 5 is 0;
    its labels are not read. The remainders 1 to 4 are the folds. Labels that disagree or are null teach
    nothing. ``bits`` is the length-normalised excess of the toxic model, ``score`` its probability and ``predicted`` whether
    that is 0.5 or more. Null and empty texts have no words and score as such texts
    do; a null id is not held out and has no label; equal rows get equal scores; other columns are not read. Without
    labels of both classes every document gets the classes' share (a half without any). An
    empty table gives an empty result. ``text_key`` is the 64-bit hash of the text."""
    spark = docs.sparkSession
    path = run_dir(spark, "toxicity")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_of()).alias("text_key"), F.lit(None).cast("string").alias("lang"), F.lower(text_of()).alias("text"))
    blocks = written_bucketed(rows.mapInArrow(_blocks(block_bytes), _BLOCKS), f"{path}/blocks", "block")
    remainder = F.crc32(F.col("doc_id").cast("string").cast("binary")) % (FOLDS + 1)
    told = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic").where("toxic IS NOT NULL").groupBy("doc_id").agg(F.min("toxic").alias("least"), F.max("toxic").alias("most"))
    cell = F.when(F.col("most") == 1, remainder).otherwise(remainder + FOLDS).cast("int")
    told = told.where((F.col("least") == F.col("most")) & F.col("most").isin(0, 1)).select("doc_id", cell.alias("cell")).where(remainder > 0)
    places = blocks.select("block", F.posexplode("doc_ids").alias("place", "doc_id"))
    cells = written(places.join(told, "doc_id").select("block", "place", "cell"), f"{path}/cells")
    texts = blocks.select("block", "doc_ids", "keys", "langs", "sizes", "texts")
    kinds = ", ".join(f"{c} long" for c in _CELLS)
    seen = written(texts.groupBy("block").cogroup(cells.groupBy("block")).applyInArrow(_count, f"block long, gram long, n long, {kinds}"), f"{path}/grams")
    grams = written(seen.groupBy("gram").agg(*(F.sum(c).alias(c) for c in ["n", *_CELLS])), f"{path}/distinct")
    given = seen.select("block", "gram").join(ratios(grams, path), "gram").select("block", "gram", "value")
    # a document's cell goes with its block's n-grams, under a number below zero
    given = given.unionByName(cells.select("block", (-1 - F.col("place")).cast("long").alias("gram"), F.col("cell").cast("long").alias("value")))
    scored = texts.groupBy("block").cogroup(given.groupBy("block")).applyInArrow(_score, "doc_id long, text_key long, cell int, n_words long, bits double")
    scored = written(scored, f"{path}/scores")
    x = F.log2(F.col("bits") + F.lit(_FLOOR))
    step = F.round(x * _BIN).alias("step")  # at most some 16 * 15 steps
    counts = scored.where("cell > 0").groupBy(step).agg(F.count_if(F.col("cell") > FOLDS).alias("o"), F.count_if(F.col("cell") <= FOLDS).alias("t")).collect()
    a, b = fitted_curve([(r.step / _BIN, r.o, r.t) for r in sorted(counts)])
    score = 1 / (1 + F.exp(-(F.lit(a) + F.lit(b) * x)))
    held = F.coalesce(remainder == 0, F.lit(False))
    return scored.select("doc_id", "text_key", held.alias("held_out"), "n_words", "bits", score.alias("score")).withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))

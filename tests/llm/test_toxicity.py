"""The class-conditional model against a plain dictionary version, and held-out accuracy."""

import math
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from storelake.llm.toxicity import fitted_curve, toxicity_scores

SF, ORDER = "/root/testdata/sf0.01", 6


def _grams(text):
    """Per word: its n-grams, each a byte with up to five bytes of its word before it."""
    out = []
    for w in re.findall(r"(?:[A-Za-z]|[^\x00-\x7F])+", (text or "").lower()):
        b = b"\x02" + w.encode() + b"\x03"
        out.append([b[max(0, i - ORDER + 1) : i + 1].rjust(ORDER, b"\0") for i in range(1, len(b))])
    return out


def _cuts(counts):
    n = Counter(counts)
    y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
    return [0.0] + [max(0.01, k - (k + 1) * y * n[k + 1] / n[k]) if n[k] else 0.5 for k in (1, 2, 3)]


def _bits(docs, told):
    """Excess bits a word of every document, from its texts and the labels that may be learnt from."""
    grams = {i: _grams(t) for i, t in docs.items()}
    levels = {ORDER: Counter(g for words in grams.values() for w in words for g in w)}
    for o in range(ORDER - 1, 0, -1):
        levels[o] = Counter(g[1:] for g in levels[o + 1])
    parts = {}
    for o in range(1, ORDER):
        cut = _cuts(levels[o].values())
        total, less = defaultdict(int), defaultdict(float)
        for g, c in levels[o].items():
            total[g[:-1]] += c
            less[g[:-1]] += cut[min(c, 3)]
        parts[o] = (levels[o], cut, total, less)

    def shared(g):
        if not g:
            return 1 / 256
        table, cut, total, less = parts[len(g)]
        h, c = g[:-1], table[g]
        return (c - cut[min(c, 3)] + less[h] * shared(g[1:])) / total[h]

    def counted(label, without):
        c = Counter(g for i, x in told.items() if x == label and _fold(i) != without for w in grams.get(i, []) for g in w)
        total, less = defaultdict(int), defaultdict(float)
        for g, n in c.items():
            total[g[:-1]] += n
            less[g[:-1]] += cuts[label][min(n, 3)]
        return c, total, less

    cuts = {}
    for label in (0, 1):
        cuts[label] = _cuts(Counter(g for i, x in told.items() if x == label for w in grams.get(i, []) for g in w).values())
    models = {k: [counted(label, k) for label in (0, 1)] for k in (None, 1, 2, 3, 4)}
    memo = {}

    def ratio(g, k):
        if (g, k) not in memo:
            base, p = shared(g[1:]), []
            for label, (c, total, less) in enumerate(models[k]):
                n = c[g]
                p.append((n - cuts[label][min(n, 3)] + (5 + less[g[:-1]]) * base) / (total[g[:-1]] + 5))
            memo[g, k] = round(math.log2(p[1] / p[0]) * 32)
        return memo[g, k]

    out = {}
    for i, words in grams.items():
        k = _fold(i) if i in told else None
        out[i] = sum(max(0, sum(ratio(g, k) for g in w) - 128) for w in words) / 32 / (len(words) + 20)
    return out


def _fold(i):
    return zlib.crc32(str(i).encode()) % 5


@pytest.mark.parametrize("block_bytes", [20_000, 1 << 20])
def test_scores_match_brute_force(spark, block_bytes):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 150").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    told = {r.doc_id: r.toxic for r in labels.collect() if _fold(r.doc_id) and r.doc_id in texts}
    expected = _bits(texts, told)
    got = {r.doc_id: r for r in toxicity_scores(docs, labels, block_bytes=block_bytes).collect()}
    assert got.keys() == texts.keys() and sum(x > 0 for x in expected.values()) > 5
    for i, r in got.items():
        assert r.bits == pytest.approx(expected[i], abs=0.02)  # a rounding at a half may go either way
        assert r.held_out == (_fold(i) == 0) and r.predicted == (r.score >= 0.5) and r.n_words == len(_grams(texts[i]))
    near = [abs(r.bits - expected[i]) < 1e-9 for i, r in got.items()]
    assert sum(near) > 0.9 * len(near)


def test_held_out_accuracy(spark):
    """Documents whose labels were not read: toxic ones are found and clean ones left alone; the folds agree with them."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    blind = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0, F.col("toxic")))
    got = toxicity_scores(docs, blind).join(labels, "doc_id")
    share = {(r.held_out, r.toxic): r.share for r in got.groupBy("held_out", "toxic").agg(F.avg("predicted").alias("share")).collect()}
    assert share[True, 1] > 0.9 and share[True, 0] < 0.01
    assert abs(share[True, 1] - share[False, 1]) < 0.05 and share[False, 0] < 0.01
    assert got.where("held_out").corr("score", "toxic") > 0.9


def test_edges(spark, edge_docs, no_docs):
    some = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (6, 0), (8, None), (None, 1), (10, 1), (9, 0), (3, 0)], "doc_id long, toxic int")
    rows = toxicity_scores(edge_docs, some).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == edge_docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert by[3].n_words == by[4].n_words == by[5].n_words == 0 and by[3].score == by[4].score == by[5].score
    assert not by[None].held_out and by[6].n_words == 20000
    assert toxicity_scores(no_docs, some).count() == 0
    for labels in (some.where("1 = 0"), some.where("toxic = 0 AND doc_id = 6")):
        one = {r.score for r in toxicity_scores(edge_docs, labels).collect()}
        assert len(one) == 1 and one == ({0.5} if labels.count() == 0 else {0.25 if _fold(6) else 0.5})


def test_curve():
    a, b = fitted_curve([(-2.0, 90, 10), (0.0, 50, 50), (2.0, 10, 90)])
    assert b > 0 and 1 / (1 + math.exp(-a)) == pytest.approx(0.5, abs=1e-3)
    assert fitted_curve([])[1] == 0 and fitted_curve([(0.0, 5, 0)])[0] < 0
    assert fitted_curve([(0.0, 50, 0), (5.0, 0, 50)])[1] < 100  # classes apart
    assert fitted_curve([(0.0, 0, 9), (1.0, 9, 0)])[1] == 0  # never falling

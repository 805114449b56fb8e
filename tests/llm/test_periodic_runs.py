"""Periodic runs against a plain search over all periods."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from storelake.llm.periodic_runs import balanced, find_runs, periodic_runs, re_pair
from storelake.llm.queries import op13_periodic_runs, periodic_edit

SF = "/root/testdata/sf0.001"


def _brute(w, least=12):
    """(start, length, period) of all runs: for each period, the maximal stretches of equal words that far apart."""
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(least, 2 * q):
                found.setdefault((i, j - i + q), q)
            i = j + 1 if j == i else j
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def _document(rng):
    size, n = rng.choice([1, 2, 3, 5, 50]), rng.choice([0, 1, 5, 12, 13, 30, 100, 200])
    w = [rng.randrange(size) for _ in range(n)]
    if n and rng.random() < 0.6:
        a = rng.randrange(n)
        p = 1 + (n - a) // (3 + rng.randrange(8))
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        if rng.random() < 0.5:
            w += [rng.randrange(size) for _ in range(rng.randint(0, 30))]
            w += w[: rng.randint(0, 40)]
    if rng.random() < 0.1:  # a Fibonacci word: many runs of many periods
        x, w = [0], [0, 1]
        while len(w) < 150:
            x, w = w, w + x
    return w


def test_runs_match_brute_force():
    rng = random.Random(1)
    for _ in range(150):
        docs = [_document(rng) for _ in range(rng.randint(1, 6))]
        ids, offsets = np.array([x for w in docs for x in w], np.int64), np.cumsum([0] + [len(w) for w in docs])
        expected = [[d, *r] for d, w in enumerate(docs) for r in _brute(w)]
        assert find_runs(ids, offsets).tolist() == expected


def test_grammar_derives_the_words():
    """Every position of a rule derives the same words, and no pair is left twice in an axiom."""
    rng = random.Random(2)
    for _ in range(50):
        docs = [_document(rng) for _ in range(3)]
        doc = np.repeat(np.arange(3), [len(w) for w in docs])
        words = np.array([x for w in docs for x in w], np.int64)
        if not len(words):
            continue
        own = np.unique(doc * 100 + words, return_inverse=True)[1]
        nodes, axiom = re_pair(own, doc)
        said: dict[int, tuple] = {}
        name = {}
        for rule, s, m, e in nodes.T.tolist():
            assert doc[s] == doc[e - 1] and said.setdefault(rule, (tuple(own[s:e]), m - s)) == (tuple(own[s:e]), m - s)
            name[s, e] = rule
        assert sum(e - s for _, s, e in axiom.T.tolist()) == len(words)
        for d in range(3):
            left = [name.get((s, e), -1 - own[s]) for k, s, e in axiom.T.tolist() if k == d]
            pairs = list(zip(left, left[1:], strict=False))
            assert len(set(pairs)) >= len(pairs) - sum(a == b == c for a, b, c in zip(left, left[1:], left[2:], strict=False))
        tops = {(s, e) for s, _, e in balanced(axiom).T.tolist()}
        for d, w in enumerate(docs):
            a = sum(map(len, docs[:d]))
            assert len([1 for k in axiom[0] if k == d]) < 2 or (a, a + len(w)) in tops


@pytest.mark.parametrize("n", [1, 30_000])
def test_one_word_over_and_over(n):
    got = find_runs(np.zeros(n, np.int64), np.array([0, n])).tolist()
    assert got == ([[0, 0, n, 1]] if n >= 12 else [])


def _words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def _edited(doc_id, text):
    w = _words(text)
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(w)
    if h % 10 or not n:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def test_query_matches_brute_force(spark):
    rows = {r.doc_id: r for r in op13_periodic_runs(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert len(rows) == len(docs)
    for d in docs:
        w = _edited(d.doc_id, d.text)
        if len(w) > 2500:  # the plain search is quadratic
            continue
        runs, got = _brute(w), rows[d.doc_id]
        keep = [x for i, x in enumerate(w) if not any(s + q <= i < s + n for s, n, q in runs)]
        assert got.n_runs == len(runs) and got.n_words == len(w)
        assert got.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert got.collapsed_sha256 == hashlib.sha256(" ".join(keep).encode()).hexdigest()
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        mine = (got.start, got.length, got.period, got.exponent_milli)
        assert mine == ((*best, 1000 * best[1] // best[2]) if best else (None,) * 4)
    assert sum(r.n_runs > 0 for r in rows.values()) > 10


def test_edges(spark, edge_docs, no_docs):
    rows = periodic_runs(edge_docs).collect()
    assert len(rows) == edge_docs.count() and periodic_runs(no_docs).count() == 0
    by = {r.doc_id: r for r in rows}
    assert by[3].n_words == by[4].n_words == by[5].n_words == 0 and by[3].runs == [] and by[5].collapsed == ""
    assert [tuple(r) for r in by[6].runs] == [(0, 20000, 5)] and by[6].collapsed == "lorem ipsum dolor sit amet"
    assert [tuple(r) for r in by[7].runs] == [(0, 20000, 5)] and by[7].collapsed == "lorem ipsum dolor sit amet x"
    assert by[9].collapsed == "one" and by[8].collapsed == "ÄÖÜ 中文 😀 don't 'tis"
    again = periodic_runs(edge_docs.repartition(5)).orderBy("doc_id", "collapsed").collect()
    assert again == sorted(rows, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.collapsed))
    assert periodic_edit(edge_docs.where(F.col("doc_id").isNull())).first().text == "a text without a number"

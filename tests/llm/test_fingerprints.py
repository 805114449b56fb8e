"""Fingerprints: exact digests, estimates against full sets, merging."""

import hashlib
import random

import numpy as np
import pytest

from storelake.llm import fingerprints as fp
from storelake.llm.near_dedup import word_shingles


def _jaccard(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def _sketch(text):
    import pyarrow as pa

    return fp.sketches(pa.array([text], pa.large_string()))[0]


def test_edited_pairs(spark):
    rng = random.Random(1)
    words = [f"w{i}é" for i in range(400)]
    docs = [(i * 7 - 50, " ".join(rng.choice(words) for _ in range(rng.randint(0, 900)))) for i in range(60)]
    got = {r.doc_id: r for r in fp.edited_pairs(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    order = sorted(docs, reverse=True)
    assert got.keys() == {d for d, _ in docs}
    errors = []
    for i, (d, t) in enumerate(order):
        after = order[(i + 1) % len(order)][1]
        cut = len(t) // 3
        edited = t[: len(t) - cut] + after[:cut]
        r = got[d]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.fingerprint == fp.pack(_sketch(t)) and r.edited_fingerprint == fp.pack(_sketch(edited))
        errors.append(r.near_edited - _jaccard(word_shingles(t, 5), word_shingles(edited, 5)))
        assert r.near_next == pytest.approx(_jaccard(word_shingles(t, 5), word_shingles(after, 5)), abs=0.15)
    assert np.abs(errors).mean() < 0.05


def test_sketches():
    rng = random.Random(2)
    a = [str(rng.random()) for _ in range(3000)]
    b = a[:1500] + [str(rng.random()) for _ in range(1500)]
    x, y = _sketch(" ".join(a)), _sketch(" ".join(b))
    assert len(x) == fp.SIZE and (np.diff(x.astype(np.int64)) > 0).all()
    assert fp.unpack(fp.pack(x)).tolist() == x.tolist()
    assert fp.distinct_shingles(x) == pytest.approx(2996, rel=0.3)
    assert fp.resemblance(x, y) == pytest.approx(1 / 3, abs=0.15)
    assert fp.containment(_sketch(" ".join(a[:1500])), x) == pytest.approx(1, abs=0.25)
    assert fp.resemblance(x[:0], x[:0]) == 1.0 and fp.resemblance(x, x[:0]) == 0.0


def test_merge(spark):
    """Fingerprints of parts merge into the fingerprint of all shingles."""
    rng = random.Random(3)
    parts = [(k, " ".join(str(rng.randrange(10**6)) for _ in range(300))) for k in range(3) for _ in range(6)]
    df = spark.createDataFrame([(i, k, t) for i, (k, t) in enumerate(parts)], "doc_id long, grp long, text string")
    prints = fp.fingerprint(df).join(df.select("doc_id", "grp"), "doc_id")
    got = {r.grp: r for r in fp.merged_fingerprints(prints.select("grp", "fingerprint"), "grp").collect()}
    for k in range(3):
        every = np.unique(np.concatenate([_sketch(t) for g, t in parts if g == k]))[: fp.SIZE]
        assert got[k].fingerprint == fp.pack(every)
        assert got[k].n_distinct == pytest.approx(6 * 296, rel=0.35)


def test_edges(edge_docs, no_docs):
    got = fp.edited_pairs(edge_docs).collect()
    assert len(got) == edge_docs.count()
    by = {r.doc_id: r for r in got}
    assert by[3].n_chars == 0 and by[3].fingerprint == "" == by[4].fingerprint
    assert by[1].fingerprint == by[2].fingerprint == by[10].fingerprint
    assert fp.edited_pairs(no_docs).count() == 0 and fp.fingerprint(no_docs).count() == 0
    one = fp.edited_pairs(edge_docs.where("doc_id = 8")).collect()[0]
    assert one.near_next == 1.0

"""Exact and near dedup against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from storelake.llm import near_dedup as nd
from storelake.llm.exact_dedup import exact_dedup, grow_directory, keep_first_of_equal
from storelake.llm.near_dedup import keep_one_of_near, least_matches, near_duplicates, word_shingles


def _norm(t):
    return "".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r")


def test_exact_edges(edge_docs):
    got = exact_dedup(edge_docs).collect()
    rows = edge_docs.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    groups = {}
    for r in rows:
        groups.setdefault(_norm(r.text), []).append((-len(r.text or ""), r.doc_id is None, r.doc_id))
    best = {k: min(v, key=lambda x: (x[0], x[1], x[2] or 0)) for k, v in groups.items()}
    kept = sorted(x[2] for x in best.values() if x[2] is not None)
    assert sorted(r.doc_id for r in got if r.kept and r.doc_id is not None) == kept
    assert sum(r.kept for r in got) == len(groups)  # one row stays of repeated rows too
    assert {r.doc_id: r.group_size for r in got}[2] == 3
    stay = keep_first_of_equal(edge_docs)
    assert stay.columns == edge_docs.columns and stay.count() == len(groups)


def test_exact_empty(no_docs):
    assert exact_dedup(no_docs).count() == 0
    assert keep_first_of_equal(no_docs).count() == 0


def test_copies_in_many_partitions_meet_in_one_chain(spark):
    """Partial entries of one text, from many map tasks, become one link with all its copies."""
    rows = [(i, "hot text" if i % 3 else f"cold text {i}" + " " * (i % 2)) for i in range(300)]
    got = exact_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(16), bucket_entries=10).collect()
    hot = [r for r in got if r.doc_id % 3]
    assert len(got) == 300 and {(r.keep_id, r.group_size, r.chain) for r in hot} == {(1, 200, 0)} and sum(r.kept for r in hot) == 1
    assert all(r.kept and r.group_size == 1 for r in got if r.doc_id % 3 == 0) and len({r.bucket for r in got}) > 3


def test_directory_splits_only_overfull(spark, tmp_path):
    keys = spark.range(20000).select(F.xxhash64("id").alias("key"))
    d = grow_directory(keys, str(tmp_path), 1500, 10).collect()
    width = {r.bucket: r.depth for r in d}
    for r in d:  # a bucket is the range of its leading bits
        assert r.slot >> (10 - r.depth) == r.bucket >> (10 - r.depth) and r.bucket % (1 << (10 - r.depth)) == 0
    held = keys.select(F.shiftrightunsigned("key", 54).alias("slot")).collect()
    where = {r.slot: r.bucket for r in d}
    load = {}
    for r in held:
        load[where[r.slot]] = load.get(where[r.slot], 0) + 1
    assert max(load.values()) <= 1500 and min(width.values()) >= 3


def test_exact_same_result_at_any_bucket_size(edge_docs, texts):
    cols = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert texts(exact_dedup(edge_docs, bucket_entries=1, max_depth=4).select(*cols)) == texts(exact_dedup(edge_docs).select(*cols))


def _brute(docs, k, percent):
    sets = {d: word_shingles(t or "", k) for d, t in docs}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(sets[d]), find(d)) for d in ids}


@pytest.mark.parametrize(("k", "edit", "chunk", "stars"), [(2, 0.03, 500, 3), (5, 0.02, 3, 1)])
def test_near_matches_brute_force(spark, monkeypatch, k, edit, chunk, stars):
    monkeypatch.setattr(nd, "CHUNK", chunk)
    monkeypatch.setattr(nd, "STAR_ROUNDS", stars)
    rng = random.Random(k)
    words = [f"w{i}" for i in range(300)]
    docs = []
    for _ in range(40):
        base = [rng.choice(words) for _ in range(rng.randint(1, 120))]
        for _ in range(rng.randint(1, 8)):  # chains of edits: members that are not alike end to end
            docs.append((len(docs), " ".join(base)))
            base = [rng.choice(words) if rng.random() < edit else w for w in base]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), k=k).collect()}
    assert got == _brute(docs, k, 80)


def test_near_large_group_forms_no_square(spark, monkeypatch):
    """One group of 400 near copies: the pairs compared stay near the number of members."""
    rng = random.Random(5)
    base = [f"w{rng.randrange(500)}" for _ in range(200)]
    docs = []
    for i in range(400):
        own = list(base)
        own[rng.randrange(200)] = f"x{i}"
        docs.append((i, " ".join(own)))
    sizes = []
    real = nd.written

    def spy(df, path):
        out = real(df, path)
        if path.endswith("/pairs"):
            sizes.append(out.count())
        return out

    monkeypatch.setattr(nd, "written", spy)
    got = near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), k=2).collect()
    assert {r.component_id for r in got} == {0}
    assert sum(sizes) < 20 * len(docs)


def test_near_edges(edge_docs, no_docs):
    got = near_duplicates(edge_docs, k=2)
    rows = got.collect()
    assert len(rows) == edge_docs.count()
    by = {r.doc_id: r for r in rows}
    assert by[10].component_id == by[2].component_id == 1 and by[7].component_id == 6
    assert by[3].n_shingles == by[4].n_shingles == by[5].n_shingles == 0 and by[3].kept and by[4].kept and by[5].kept
    assert by[9].n_shingles == 1 and by[9].kept
    stay = keep_one_of_near(edge_docs, k=2)
    assert stay.columns == edge_docs.columns
    assert sorted(r.doc_id for r in stay.collect() if r.doc_id is not None) == [1, 3, 4, 5, 6, 8, 9]
    assert near_duplicates(no_docs).count() == 0 and keep_one_of_near(no_docs).count() == 0


def test_bayes_bound_keeps_likely_pairs():
    # all minima equal is never dropped, few matches are
    for n in (40, 80, 200):
        assert 0 < least_matches(n, 0.8, 1e-6) < 0.8 * n

"""The pipeline stage by stage, and its registration."""

import hashlib

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline as cp
from storelake.llm.exact_dedup import exact_dedup
from storelake.llm.near_dedup import near_duplicates, word_shingles
from storelake.llm.quality import quality_scores

SF = "/root/testdata/sf0.001"


def _norm(t):
    return "".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r")


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    # 3: what the classifier rejects goes
    kept = {r.doc_id for r in quality_scores(docs, labels).where("kept").collect()}
    out = cp.quality(spark, docs, SF)
    assert out.columns == columns and {r.doc_id for r in out.collect()} == kept and len(kept) < docs.count()
    # 1: the longest of equal texts, then the smallest id
    out.write.parquet(f"{tmp_path}/0")
    docs = spark.read.parquet(f"{tmp_path}/0")
    rows = docs.collect()
    best = {}
    for r in sorted(rows, key=lambda r: (-len(r.text), r.doc_id)):
        best.setdefault(_norm(r.text), r.doc_id)
    out = cp.exact(spark, docs, SF)
    assert out.columns == columns and sorted(r.doc_id for r in out.collect()) == sorted(best.values())
    # 2: the smallest id of each component of five-word sets
    out.write.parquet(f"{tmp_path}/1")
    docs = spark.read.parquet(f"{tmp_path}/1")
    sets = {r.doc_id: word_shingles(r.text, 5) for r in docs.collect()}
    comp = {d: d for d in sets}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                comp[y] = x
    out = cp.near(spark, docs, SF)
    assert out.columns == columns and sorted(r.doc_id for r in out.collect()) == [d for d in ids if find(d) == d]
    # 5 and 8: the mix keeps whole rows, the tokens decode to the texts
    out.write.parquet(f"{tmp_path}/2")
    docs = spark.read.parquet(f"{tmp_path}/2")
    mix = cp.mix(spark, docs, SF)
    assert mix.columns == columns and mix.exceptAll(docs).count() == 0
    tokens = {r.doc_id: r for r in cp.tokens(spark, mix, SF).collect()}
    for r in mix.collect():
        assert tokens[r.doc_id].decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest()


def test_run_equals_stages(spark):
    whole = {r.doc_id: r.n_tokens for r in cp.run(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert whole and whole.keys() <= {r.doc_id for r in docs.collect()}
    assert [name for name, _ in cp.STAGES] == ["quality classifier", "exact dedup", "near-dedup", "mixing", "bpe"]


@pytest.mark.parametrize("stage", [f for _, f in cp.STAGES])
def test_stages_take_edges(spark, edge_docs, no_docs, stage):
    out = stage(spark, edge_docs, SF)
    assert out.count() <= edge_docs.count()
    if stage is not cp.STAGES[-1][1]:
        assert out.columns == edge_docs.columns
    assert stage(spark, no_docs, SF).count() == 0


def test_registered():
    names = entry.queries()
    for n in range(1, 11):
        assert len([q for q in names if q.startswith(f"op{n}_")]) == 1
    assert "pipeline" in names


def test_native_operators_run_no_python(spark):
    for q in ("op1_exact_dedup", "op6_chat_formatting"):
        plan = entry.queries()[q](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "CartesianProduct", "BroadcastNestedLoopJoin"))


def test_near_default_is_five_words(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h i j"), (2, "a b c d e f g h i k")], "doc_id long, text string")
    assert near_duplicates(docs).select(F.max("n_shingles")).first()[0] == 6
    assert exact_dedup(docs).where("kept").count() == 2

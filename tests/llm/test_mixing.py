"""Pfair schedules and the mix."""

from math import ceil

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from storelake.llm.mixing import mix_sources, mixed, pfair_period, target_weights


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 40), min_size=1, max_size=8))
def test_period_is_pfair(parts):
    weights = {f"s{i}": w for i, w in enumerate(parts)}
    q = sum(parts)
    plan = pfair_period(weights, q)
    assert [x[2] for x in plan] == list(range(q))
    done = dict.fromkeys(weights, 0)
    for k, i, slot, release, deadline in plan:
        assert i == done[k] and release <= slot < deadline
        assert release == i * q // weights[k] and deadline == ceil((i + 1) * q / weights[k] - 1e-9)
        done[k] += 1
        assert all(abs(weights[x] * (slot + 1) / q - done[x]) < 1 for x in weights)  # less than one block off
    assert done == weights


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.text(min_size=1, max_size=3), st.integers(1, 10**6), min_size=1, max_size=30))
def test_targets(shares):
    w = target_weights(shares, 0.25, 1000)
    assert sum(w.values()) == 1000 and min(w.values()) >= 1 and w.keys() == shares.keys()
    total = sum(shares.values())
    for k, v in shares.items():  # nothing loses more than half of its text, and the mix is no larger than all text
        assert w[k] >= v / total * 1000 / 2 - len(shares) - 1
    if max(shares.values()) / total <= 0.25:  # nothing above the ceiling: natural shares
        assert all(abs(w[k] - v / total * 1000) <= len(shares) + 1 for k, v in shares.items())


def test_ceiling_and_most_trim():
    w = target_weights({"hot": 600, "b": 200, "c": 200, "d": 200, "e": 200}, 0.25, 1000)
    assert abs(w["hot"] - 1000 * 300 / 1100) <= 1  # half of its own text: a quarter of the mix would be less
    assert target_weights({"big": 99, "small": 1}, 0.25, 1000)["big"] > 950


def _docs(spark, sizes):
    rows = [(i * 100 + s, "x" * 50, name, None) for s, (name, n) in enumerate(sizes.items()) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")


def test_mix_against_brute_force(spark):
    """Slots follow from the blocks of each source; shares of any prefix are off by less than a block."""
    docs = _docs(spark, {"a": 300, "b": 100, "c": 50})
    got = mix_sources(docs, weights={"a": 2, "b": 1, "c": 1}, block_chars=200).collect()
    assert len(got) == 450
    q, w = 4, {"a": 2, "b": 1, "c": 1}
    period = {(k, i): (slot, r, d) for k, i, slot, r, d in pfair_period(w, q)}
    for r in got:
        assert r.block == r.offset // 200
        slot, release, deadline = period[r.source, r.block % w[r.source]]
        base = r.block // w[r.source] * q
        assert (r.slot, r.release, r.deadline) == (base + slot, base + release, base + deadline)
    for s in w:  # the offsets of a source are the running sum of its characters
        mine = sorted(r.offset for r in got if r.source == s)
        assert mine == [50 * i for i in range(len(mine))]
    first_out = min(max(r.slot for r in got if r.source == s) for s in w)
    assert all(r.in_mix == (r.slot <= first_out) for r in got)
    for t in range(0, first_out, 7):
        for s in w:
            blocks = len({r.block for r in got if r.source == s and r.slot < t})
            assert abs(blocks - w[s] / q * t) < 1


def test_only_a_source_over_its_target_gives_way(spark):
    docs = _docs(spark, {"hot": 600, "b": 200, "c": 200, "d": 200, "e": 200})
    got = mix_sources(docs, block_chars=100)
    left = {r.source: (r.n, r.kept) for r in got.groupBy("source").agg(F.count("*").alias("n"), F.count_if("in_mix").alias("kept")).collect()}
    assert all(left[s] == (200, 200) for s in "bcde")
    total = sum(k for _, k in left.values())
    assert left["hot"][1] == pytest.approx(300, abs=6)  # half of it: a quarter of the mix would be 267
    stay = mixed(docs, block_chars=100)
    assert stay.columns == docs.columns and stay.count() == total


def test_small_sources_share_a_lane(spark):
    docs = _docs(spark, {**dict.fromkeys("abcde", 90), **{f"t{i}": 1 for i in range(6)}})
    got = mix_sources(docs, period=20, block_chars=100)
    assert got.where("lane = '(small sources)'").count() == 6
    assert got.where("in_mix").count() == got.count()


def test_edges(edge_docs, no_docs):
    got = mix_sources(edge_docs).collect()
    assert len(got) == edge_docs.count() and {r.source for r in got} == {"a", "b", "c", "d", "(none)"}
    stay = mixed(edge_docs)
    assert stay.columns == edge_docs.columns
    assert stay.count() == sum(r.in_mix for r in got)
    assert mix_sources(no_docs).count() == 0 and mixed(no_docs).count() == 0


def test_the_surplus_stays_behind_the_balanced_part(spark):
    import corpus_pipeline as cp

    docs = _docs(spark, {"hot": 600, "b": 200, "c": 200})
    long = docs.withColumn("text", F.expr("repeat(text, 100)"))  # 30 blocks of the largest source
    assert mixed(long).count() < 1000
    assert cp.mix(spark, long, "").exceptAll(long).count() == 0 and cp.mix(spark, long, "").count() == 1000
    plan = {r.doc_id: r for r in mix_sources(docs, block_chars=100).collect()}
    out = [r.doc_id for r in mixed(docs, surplus=True, block_chars=100).collect()]
    assert sorted(out) == sorted(plan) and not all(r.in_mix for r in plan.values())
    assert [plan[d].slot for d in out] == sorted(r.slot for r in plan.values())
    assert sorted(plan[d].in_mix for d in out)[::-1] == [plan[d].in_mix for d in out]

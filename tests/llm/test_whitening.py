"""Whitening against numpy's eigendecomposition of the whole covariance."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from storelake.llm.queries import op11_whitening
from storelake.llm.whitening import Spectrum, rank_one, secular_roots, whiten

SF = "/root/testdata/sf0.01"


def _rows(rng, kind, n, d):
    if kind == "full":
        return rng.normal(size=(n, d)) @ rng.normal(size=(d, d)) * 100 + 1e5
    if kind == "low rank":
        return rng.normal(size=(n, 2)) @ rng.normal(size=(2, d)) * 100 + 1e5
    if kind == "equal values":
        return np.tile(np.vstack([np.eye(d), -np.eye(d)]) * 50, (math.ceil(n / (2 * d)), 1))[:n] + 1e5
    return np.full((n, d), 100007.0)


def test_roots_interlace_and_solve():
    rng = np.random.default_rng(1)
    for k in (1, 2, 9, 40):
        d = np.sort(rng.normal(size=k)) * 10.0 ** rng.integers(-6, 6)
        z2, rho = rng.random(k) ** 8 + 1e-12, 10.0 ** rng.integers(-3, 3)
        pole, t = secular_roots(d, z2, rho)
        roots = d[pole] + t
        true = np.linalg.eigvalsh(np.diag(d) + rho * np.outer(np.sqrt(z2), np.sqrt(z2)))
        assert np.allclose(roots, true, rtol=1e-10, atol=1e-12 * np.abs(true).max())
        assert (roots >= d).all() and (roots[:-1] <= d[1:]).all()


@pytest.mark.parametrize("kind", ["full", "low rank", "equal values", "one point"])
@pytest.mark.parametrize("d", [1, 2, 7, 32])
def test_merged_spectra_equal_the_whole(kind, d):
    x = _rows(np.random.default_rng(2), kind, 150, d)
    held = Spectrum.empty(d)
    for part in np.split(x, [0, 1, 10, 100]):
        own = Spectrum.empty(d)
        for row in part:
            own.add(row)
        held.merge(own)
    c = x - x.mean(0)
    scatter = c.T @ c
    size = max(1.0, np.abs(scatter).max())
    assert held.n == len(x) and np.allclose(held.mean, x.mean(0), rtol=1e-12)
    assert np.abs(held.vectors.T @ held.vectors - np.eye(d)).max() < 1e-12
    assert np.abs(held.vectors * held.values @ held.vectors.T - scatter).max() < 1e-10 * size
    values, vectors = rank_one(held.values, held.vectors, 3.0, c[0])
    assert np.abs(vectors * values @ vectors.T - scatter - 3 * np.outer(c[0], c[0])).max() < 1e-10 * size


def test_query_matches_numpy(spark):
    got = op11_whitening(spark, SF).toPandas()
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    rows = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([[math.floor(1024 * c) + 100000 for c in v] for _, v in rows], np.int64)
    n, total = len(x), x.sum(0)
    centred = x - total / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:8], vectors[:, ::-1][:, :8]
    assert len(got) == 8 * n and set(got.n) == {n}
    wide = got.pivot(index="vec_id", columns="component", values="whitened").loc[[i for i, _ in rows]].to_numpy()
    expected = centred @ vectors / np.sqrt(values)
    sign = np.sign((wide * expected).sum(0))
    assert np.abs(wide * sign - expected).max() < 1e-9
    assert np.allclose(got.groupby("component").explained.first(), values / np.trace(centred.T @ centred / n), rtol=1e-10)
    deviation = got[got.component == 1].set_index("vec_id").deviation
    assert [int(deviation[i]) for i, _ in rows] == [sum((n * int(a) - int(s)) ** 2 for a, s in zip(v, total, strict=True)) for v in x]
    assert got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-10


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [3.0, 1.0]), (None, [0.0, 7.0]), (3, None), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, []), (8, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "'x' AS n", "'x' AS id", "'x' AS vector", "'x' AS component")
    got = whiten(df.repartition(4)).toPandas()
    assert len(got) == 8 and set(got.component) == {1, 2} and set(got.n) == {4}
    assert sorted(got.vec_id.dropna().tolist()) == [1] * 4 + [2] * 2 and got.identity_error.max() < 1e-12
    assert whiten(df.where("vec_id IS NULL AND embedding IS NULL")).count() == 0 and whiten(df.where("1 = 0")).count() == 0
    same = whiten(df.where("vec_id = 1")).toPandas()  # nothing varies
    assert len(same) == 4 and same.whitened.isna().all() and same.explained.isna().all() and (same.identity_error == 0).all()
    one = whiten(df.where("vec_id <= 2")).toPandas()  # all on one line
    assert one[one.component == 1].whitened.notna().all() and one[one.component == 2].whitened.isna().all()
    assert one[one.component == 1].explained.iloc[0] == pytest.approx(1.0) and one.identity_error.max() < 1e-12
    big = spark.createDataFrame([(1, [1 << 50, 0]), (2, [0, 5]), (3, [7, 7])], "vec_id long, embedding array<long>")
    assert {r.deviation for r in whiten(big).where("component = 1").collect()} == {None}  # beyond a long


def test_partitions_do_not_matter(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet").where("vec_id < 300")
    hot = df.unionByName(df.where("vec_id < 2").withColumn("again", F.explode(F.sequence(F.lit(1), F.lit(150)))).drop("again"))
    a, b = (whiten(x).groupBy("component").agg(F.first("explained").alias("e"), F.count("*").alias("c"), F.sum("deviation").alias("d")).orderBy("component").collect() for x in (hot.repartition(7), hot.coalesce(1)))
    assert [(r.component, r.c) for r in a] == [(k, 600) for k in range(1, 9)]
    for x, y in zip(a, b, strict=True):
        assert x.e == pytest.approx(y.e, rel=1e-10) and x.d == pytest.approx(y.d, rel=1e-9)

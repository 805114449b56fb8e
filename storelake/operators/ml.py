"""Spark ML wrappers for the trained models.

Features go through ``VectorAssembler`` (no Python UDF); metrics come back as
a ``run_metrics(name, value)`` DataFrame instead of an external tracker.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a file of staged features (files are what a trainer's tasks share out).
FILE_ROWS = 250_000
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Most bins of a feature (Spark's default) and rows behind their borders (Spark's trainer draws 10,000).
MAX_BINS, BORDER_ROWS = 32, 100_000
#: Bins packed into one bigint: 5 bits each.
_PACKED = 12


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    A trainer goes over its input for the classes, the counts, the bins and the points, and evaluation and
    scoring go over it again: each of these reads files instead of running the feature plan once more. The
    shuffle files behind them go when they are written, not when a collection of garbage finds them."""
    from storelake.streaming.runner import run_folder

    conf, out = df.sparkSession.conf, run_folder(df.sparkSession, name)
    was = conf.get(_CLEANUP, None)
    conf.set(_CLEANUP, "true")
    try:
        df.write.option("maxRecordsPerFile", FILE_ROWS).option("compression", "zstd").parquet(out)
    finally:
        conf.unset(_CLEANUP) if was is None else conf.set(_CLEANUP, was)
    return df.sparkSession.read.schema(df.schema).parquet(out)


def _assemble(df: DataFrame, feats: Sequence[str]) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=list(feats), outputCol="features", handleInvalid="keep").transform(df)


def metrics_frame(df: DataFrame, metrics: dict[str, float]) -> DataFrame:
    spark = df.sparkSession
    return spark.createDataFrame([(k, float(v)) for k, v in metrics.items()], "name string, value double")


def borders(values: Sequence[float], bins: int) -> list[float]:
    """The bin borders of Spark's tree trainer for one feature (``RandomForest.findSplits``): the midpoints of
    neighbouring values or, when there are too many, those nearest to equal shares of the rows. A value on a
    border belongs below it; NaN stands above all."""
    import numpy as np

    v, n = np.unique(np.asarray(values, dtype=float), return_counts=True)
    mid = [(a + b) / 2 for a, b in zip(v.tolist(), v[1:].tolist(), strict=False)]
    if len(mid) >= bins:
        stride = n.sum() / bins
        seen, target, some = n[0], stride, []
        for m, k in zip(mid, n[1:].tolist(), strict=True):
            if abs(seen - target) < abs(seen + k - target):
                some.append(m)
                target += stride
            seen += k
        mid = some
    return sorted({m for m in mid if not math.isnan(m)})


class Cells:
    """Feature vectors as a tree trainer sees them. It knows a value by its bin only, so equal vectors of bins
    (cells) are one weighted row to it, and one score serves all rows of a cell. The borders are its own."""

    def __init__(self, train: DataFrame, feats: Sequence[str], seed: int):
        n = train.count()
        x = train.select(*[F.col(c).cast("double") for c in feats])
        x = (x.sample(BORDER_ROWS / n, seed) if n > BORDER_ROWS else x).toPandas()
        self.feats, self.model = list(feats), None
        self.borders = {c: borders(x[c], min(MAX_BINS, max(n, 1))) for c in self.feats}
        self.columns = [f"_cell{k}" for k in range(math.ceil(len(self.feats) / _PACKED))]

    def add(self, df: DataFrame) -> DataFrame:
        """``df`` with the cell of its features, NULL and NaN in the last bin, where a tree sends them."""
        from pyspark.ml.feature import Bucketizer

        cut = [c for c in self.feats if self.borders[c]]
        if cut:
            ends = [[-math.inf, *(math.nextafter(b, math.inf) for b in self.borders[c]), math.inf] for c in cut]
            outs = [f"_bin_{c}" for c in cut]
            df = Bucketizer(inputCols=cut, outputCols=outs, splitsArray=ends, handleInvalid="keep").transform(df)
        last = lambda c: F.lit(len(self.borders[c]))
        at = lambda c: F.least(F.coalesce(F.col(f"_bin_{c}").cast("bigint"), last(c)), last(c)) if c in cut else F.lit(0)
        packed = [sum((at(c) * F.lit(1 << 5 * k) for k, c in enumerate(self.feats[i : i + _PACKED])), F.lit(0)) for i in range(0, len(self.feats), _PACKED)]
        return df.withColumns({k: v.cast("bigint") for k, v in zip(self.columns, packed, strict=True)}).drop(*(f"_bin_{c}" for c in cut))

    def vectors(self, df: DataFrame) -> DataFrame:
        """The bin numbers of the cells of ``df`` as its features."""
        from pyspark.ml.feature import VectorAssembler

        bins = {f"_bin_{c}": F.shiftright(F.col(self.columns[k // _PACKED]), 5 * (k % _PACKED)).bitwiseAND(F.lit(31)).cast("double") for k, c in enumerate(self.feats)}
        return VectorAssembler(inputCols=[*bins], outputCol="features").transform(df.withColumns(bins)).drop(*bins)


def train_classifier(split: DataFrame, feats: Sequence[str], label: str, max_iter: int = 80, max_depth: int = 5, seed: int = 42, by_cell: bool = False):
    """GBT on split == 'train'; AUC / precision / recall / F1 on 'test'. ``split`` is computed once.

    ``by_cell`` trains on the cells of the rows, weighted by their numbers: the same trees from input that
    grows with the cells that occur, not with the rows. Its model is for ``score`` only."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    split = staged(split.select(*dict.fromkeys([*feats, label, "split"])), "train")
    bins, cells = MAX_BINS, None
    if by_cell:
        cells = Cells(split.where(F.col("split") == "train"), feats, seed)
        split = staged(cells.add(split).groupBy("split", F.col(label).cast("double").alias(label), *cells.columns).agg(F.count(F.lit(1)).cast("double").alias("_rows")), "cells")
        data = cells.vectors(split)
        # no cell may be left out of the borders: the trainer draws no fewer rows than the square of its bins
        bins = max(bins, math.isqrt(split.where(F.col("split") == "train").count()) + 1)
    else:
        data = _assemble(split.withColumn(label, F.col(label).cast("double")).withColumn("_rows", F.lit(1.0)), feats)
    train, test = data.where(F.col("split") == "train"), data.where(F.col("split") == "test")
    gbt = GBTClassifier(featuresCol="features", labelCol=label, maxIter=max_iter, maxDepth=max_depth, maxBins=bins, seed=seed)
    model = (gbt.setWeightCol("_rows") if by_cell else gbt).fit(train)
    pred = model.transform(test)
    auc = BinaryClassificationEvaluator(labelCol=label, rawPredictionCol="rawPrediction", weightCol="_rows").evaluate(pred)
    rows = lambda p, y: F.coalesce(F.sum(F.when((F.col("prediction") == p) & (F.col(label) == y), F.col("_rows"))), F.lit(0.0))
    c = pred.agg(rows(1, 1).alias("tp"), rows(1, 0).alias("fp"), rows(0, 1).alias("fn")).first()
    precision = c.tp / (c.tp + c.fp) if (c.tp + c.fp) else 0.0
    recall = c.tp / (c.tp + c.fn) if (c.tp + c.fn) else 0.0
    f1 = 2 * precision * recall / (precision + recall) if (precision + recall) else 0.0
    if cells:
        cells.model, model = model, cells
    return model, metrics_frame(split, {"auc": auc, "precision": precision, "recall": recall, "f1": f1})


def score(model, df: DataFrame, feats: Sequence[str], out_col: str = "churn_probability", keep: Sequence[str] | None = None) -> DataFrame:
    """``df``, or its columns ``keep``, with the prediction and, in ``out_col``, the probability of label 1."""
    from pyspark.ml.functions import vector_to_array

    if isinstance(model, Cells):  # a cell is scored once
        x = staged(model.add(df).select(*(keep or df.columns), *model.columns), "cells")
        cells = model.model.transform(model.vectors(x.select(*model.columns).distinct()))
        cells = cells.select(*model.columns, "prediction", vector_to_array("probability")[1].alias(out_col))
        return x.join(staged(cells, "cell_scores"), model.columns).drop(*model.columns)
    out = model.transform(_assemble(df, feats)).withColumn(out_col, vector_to_array("probability")[1])
    return out.select(*(keep or df.columns), "prediction", out_col)


def train_regressor(train: DataFrame, feats: Sequence[str], label: str, max_iter: int = 100, max_depth: int = 6, step: float = 0.1, subsample: float = 0.8, seed: int = 42):
    from pyspark.ml.regression import GBTRegressor

    data = _assemble(train.withColumn(label, F.col(label).cast("double")), feats)
    return GBTRegressor(featuresCol="features", labelCol=label, maxIter=max_iter, maxDepth=max_depth, stepSize=step, subsamplingRate=subsample, seed=seed).fit(data)


def predict(model, df: DataFrame, feats: Sequence[str], out: str = "prediction") -> DataFrame:
    return model.transform(_assemble(df, feats)).withColumnRenamed("prediction", out).drop("features")


def kmeans_best_k(df: DataFrame, feats: Sequence[str], ks: Iterable[int], seed: int = 42) -> DataFrame:
    """Standardise, fit KMeans for each k, keep the best silhouette; returns
    the assignment with k and silhouette columns."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.feature import StandardScaler

    data = _assemble(df, feats)
    scaler = StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True).fit(data)
    data = scaler.transform(data).cache()
    best = None
    try:
        for k in ks:
            model = KMeans(featuresCol="scaled", k=k, seed=seed).fit(data)
            pred = model.transform(data)
            sil = ClusteringEvaluator(featuresCol="scaled").evaluate(pred)
            if best is None or sil > best[0]:
                best = (sil, k, model)
        sil, k, model = best
        out = model.transform(data).select(*df.columns, F.col("prediction").alias("cluster"))
        return out.withColumn("k", F.lit(k)).withColumn("silhouette", F.lit(float(sil)))
    finally:
        data.unpersist()

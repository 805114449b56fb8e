"""Market-basket operators.

Pair counting is bounded by the apriori property, not by a cap: a pair can
only have support >= s if both items do, so baskets are first reduced to
their frequent items. The number F of frequent items satisfies
F * s * N <= sum of item counts = N * (mean distinct items per basket), i.e.
F <= mean basket width / s, and a basket emits at most C(min(width, F), 2)
pairs. With item domains such as department or brand (SURVEY §7.2) the
emitted pairs per basket are bounded by the domain, not by the rows of a
hot basket. Pair counts then use a partial (map-side) aggregate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def multi_item_baskets(df: DataFrame, basket: str, item: str, min_items: int = 2) -> DataFrame:
    """Distinct (basket, item) rows of baskets holding >= min_items items
    (one shuffle by basket: distinct and the basket size share it)."""
    from pyspark.sql import Window

    b = df.select(basket, item).distinct()
    return b.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(basket))).where(F.col("_n") >= min_items).drop("_n")


def item_support(df: DataFrame, basket: str, item: str) -> DataFrame:
    """Support of each item over multi-item baskets: count / N."""
    bm = multi_item_baskets(df, basket, item)
    n = bm.select(basket).distinct().count()
    return bm.groupBy(item).agg(F.count(F.lit(1)).alias("item_count")).withColumn("support", F.col("item_count") / F.lit(n))


def pair_rules(df: DataFrame, basket: str, item: str, min_support: float = 0.01, min_confidence: float = 0.3) -> DataFrame:
    """Association rules A -> B over item pairs (M14, exact twin of FP-growth's
    2-item rules): support = n(AB)/N, confidence = n(AB)/n(A),
    lift = confidence / (n(B)/N); N = number of multi-item baskets."""
    # The (basket, item) set feeds five branches (N, item counts, frequent
    # items, both sides of the self join): materialise it once with a
    # reliable checkpoint in spark.checkpoint.dir instead of rescanning.
    from storelake.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(df.sparkSession)
    bm = multi_item_baskets(df, basket, item).checkpoint(eager=True)
    n_baskets = bm.select(basket).distinct().count()
    counts = bm.groupBy(item).agg(F.count(F.lit(1)).alias("n_item"))
    frequent = counts.where(F.col("n_item") >= F.lit(min_support * n_baskets))
    fb = bm.join(frequent.select(item), item, "left_semi")
    a = fb.select(F.col(basket), F.col(item).alias("antecedent"))
    b = fb.select(F.col(basket), F.col(item).alias("consequent"))
    # each unordered pair is counted once; the mirror rule has the same count
    pairs = a.join(b, basket).where(F.col("antecedent") < F.col("consequent"))
    pc = pairs.groupBy("antecedent", "consequent").agg(F.count(F.lit(1)).alias("n_pair")).where(F.col("n_pair") >= F.lit(min_support * n_baskets))
    both = F.array(F.struct("antecedent", "consequent"), F.struct(F.col("consequent").alias("antecedent"), F.col("antecedent").alias("consequent")))
    pc = pc.select(F.explode(both).alias("x"), "n_pair").select("x.*", "n_pair")
    ca = counts.select(F.col(item).alias("antecedent"), F.col("n_item").alias("n_antecedent"))
    cb = counts.select(F.col(item).alias("consequent"), F.col("n_item").alias("n_consequent"))
    r = pc.join(ca, "antecedent").join(cb, "consequent")
    r = (
        r.withColumn("support", F.col("n_pair") / F.lit(n_baskets))
        .withColumn("confidence", F.col("n_pair") / F.col("n_antecedent"))
        .withColumn("lift", F.col("confidence") / (F.col("n_consequent") / F.lit(n_baskets)))
    )
    return r.where((F.col("support") >= min_support) & (F.col("confidence") >= min_confidence))


def fpgrowth_rules(df: DataFrame, basket: str, item: str, min_support: float = 0.01, min_confidence: float = 0.3, top: int = 100) -> DataFrame:
    """Spark ML FP-growth over multi-item baskets; rules ranked by lift
    (top ``top``), with true support (G03)."""
    from pyspark.ml.fpm import FPGrowth

    bm = multi_item_baskets(df, basket, item)
    items = bm.groupBy(basket).agg(F.collect_set(F.col(item).cast("string")).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(items)
    rules = model.associationRules
    return rules.orderBy(F.desc("lift"), F.asc(F.array_join("antecedent", ",")), F.asc(F.array_join("consequent", ","))).limit(top)


def recommendation_pairs(rules: DataFrame) -> DataFrame:
    """One row per (antecedent item, consequent item) of each rule."""
    return rules.select(F.explode("antecedent").alias("item"), F.col("consequent"), "confidence", "lift").select(
        "item", F.explode("consequent").alias("recommended"), "confidence", "lift"
    )

"""Mixing sources to target weights by Pfair scheduling.

Every source is cut into blocks of ``block_chars`` characters, in a hashed order
of its documents. A source of weight w = a / Q gets one block in each window: block i
is released at floor(i / w) and due at ceil((i + 1) / w). Earliest deadline first over the
released blocks gives a source after t slots w * t blocks, off by less than one.

The schedule has period Q (all sources are level again after Q slots), so only one period
is computed: Q rows, whatever the size of the corpus. Block b of a source runs in
slot (b div a) * Q + slot of block (b mod a) in the period.

Sources with less than 1 / Q of the text share one lane, in which they keep their
natural proportion; so there are at most Q lanes. Positions within a source are
prefix sums over (source, hash range) segments: a source with a third of all
rows is spread over many tasks.
"""

from __future__ import annotations

import heapq
from fractions import Fraction
from math import ceil

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storelake.llm.common import packed, run_dir, text_of, written

POOL = "(small sources)"
NO_SOURCE = "(none)"
_SEGMENT_BITS = 12


def target_weights(shares: dict[str, int], ceiling: float, period: int, most_trim: float = 0.5) -> dict[str, int]:
    """Integer weights that sum to ``period``, at least 1 each: natural shares, with sources
    that would hold more than ``ceiling`` of the mix brought down to it while all others keep
    their text, but none by more than ``most_trim`` of its text."""
    total = sum(shares.values())
    natural = {k: v / total for k, v in shares.items()}
    top = max(ceiling, 1 / len(shares))
    w, full = dict(natural), set()
    while over := {k for k, v in w.items() if v > top + 1e-12 and k not in full}:
        full |= over
        rest = sum(shares[k] for k in shares if k not in full)
        left = 1 - top * len(full)
        w = {k: top if k in full else left * shares[k] / rest for k in shares}
    free = next((k for k in shares if k not in full), None)
    if free is not None:  # what each source keeps if those below the ceiling keep all
        scale = natural[free] / w[free]
        kept = {k: max(w[k] * scale, natural[k] * (1 - most_trim)) if k in full else natural[k] for k in shares}
        w = {k: v / sum(kept.values()) for k, v in kept.items()}
    whole = {k: max(1, int(v * period)) for k, v in w.items()}
    order = sorted(w, key=lambda k: (whole[k] - w[k] * period, k))
    i = 0
    while (missing := period - sum(whole.values())) != 0:
        k = order[i % len(order)] if missing > 0 else max(whole, key=lambda x: (whole[x], x))
        whole[k] += 1 if missing > 0 else -1
        i += 1
    return whole


def pfair_period(weights: dict[str, int], period: int) -> list[tuple[str, int, int, int, int]]:
    """(lane, block, slot, release, deadline) of one period, by earliest deadline among the released."""
    due = lambda k, i: ceil(Fraction((i + 1) * period, weights[k]))
    waiting = [(0, k, 0) for k in weights]
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int, int]] = []
    out = []
    for slot in range(period):
        while waiting and waiting[0][0] <= slot:
            release, k, i = heapq.heappop(waiting)
            heapq.heappush(ready, (due(k, i), k, i, release))
        deadline, k, i, release = heapq.heappop(ready)
        out.append((k, i, slot, release, deadline))
        if i + 1 < weights[k]:
            heapq.heappush(waiting, ((i + 1) * period // weights[k], k, i + 1))
    return out


def mix_sources(docs: DataFrame, weights: dict[str, int] | None = None, ceiling: float = 0.25, most_trim: float = 0.5, period: int = 1000, block_chars: int = 100_000) -> DataFrame:
    """One row per input row: ``doc_id, text_key, source, lane, n_chars, block, slot,
    release, deadline, offset, in_mix``.

    Order by (slot, offset) to read the mix. ``weights`` gives integer weights by source
    (sources not named get none and leave the mix; ``period`` is their sum); else weights are the natural shares with no source
    above ``ceiling``, though none gives up more than ``most_trim`` of its text for that. A source
    over its target has surplus blocks: what comes after the last block of all other sources
    is not ``in_mix``. All else is. A null source is a
    source of its own ('(none)'); null texts have length 0; rows without an id and
    repeated rows are documents like any other. Empty input, empty result."""
    spark = docs.sparkSession
    path = run_dir(spark, "mix")
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit(NO_SOURCE)).alias("source"), text_of().alias("text"))
    rows = written(named.select("doc_id", "source", F.length("text").cast("long").alias("n_chars"), F.xxhash64("text").alias("text_key")), f"{path}/rows")

    total = F.sum("n_chars")
    by_source = rows.groupBy("source").agg(total.alias("chars"), F.count("*").alias("docs")).withColumn("chars", F.greatest("chars", F.lit(1)))
    if weights is None:
        all_chars = by_source.agg(F.sum("chars")).first()[0] or 0
        small = F.col("chars") * period < F.lit(all_chars)
        lanes = written(by_source.withColumn("lane", F.when(small, F.lit(POOL)).otherwise(F.col("source"))), f"{path}/lanes")
        # a lane has 1/period of the text, or is the pool: at most period + 1 rows
        shares = {r["lane"]: int(r["chars"]) for r in lanes.groupBy("lane").agg(F.sum("chars").alias("chars")).collect()}
        targets = target_weights(shares, ceiling, period, most_trim) if shares else {}
        natural = {k: v / max(1, sum(shares.values())) for k, v in shares.items()}
        trimmed = {k for k in targets if targets[k] / period < natural[k] - 1.0 / period}
    else:
        period, targets = sum(weights.values()), {k: v for k, v in weights.items() if v > 0}
        lanes = by_source.withColumn("lane", F.col("source")).where(F.col("source").isin(*targets))
        trimmed = set(targets)
    plan = pfair_period(targets, period) if targets else []
    schedule = spark.createDataFrame([(k, targets[k], *x) for k, *x in plan], "lane string, weight long, turn long, slot long, release long, deadline long")

    # prefix sums of characters in the hashed order of each lane
    placed = rows.join(F.broadcast(lanes.select("source", "lane")) if weights is not None else lanes.select("source", "lane"), "source")
    key = F.xxhash64("doc_id", "text_key", "source")
    placed = placed.withColumn("key", key).withColumn("segment", F.shiftrightunsigned("key", 64 - _SEGMENT_BITS))
    before = Window.partitionBy("lane").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("lane", "segment").agg(total.alias("chars")).select("lane", "segment", F.coalesce(F.sum("chars").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("lane", "segment").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.col("start") + F.coalesce(F.sum("n_chars").over(inside), F.lit(0))
    cut = placed.join(starts, ["lane", "segment"]).withColumn("offset", offset).withColumn("block", F.expr(f"offset div {int(block_chars)}L"))

    # the schedule has period rows
    by_lane = schedule.select("lane", "weight").distinct()
    turned = cut.join(F.broadcast(by_lane), "lane").withColumn("cycle", F.expr("block div weight")).withColumn("turn", F.col("block") % F.col("weight"))
    shift = F.col("cycle") * F.lit(period)
    slots = turned.join(F.broadcast(schedule.drop("weight")), ["lane", "turn"]).select("doc_id", "text_key", "source", "lane", "n_chars", "block", *((F.col(c) + shift).alias(c) for c in ("slot", "release", "deadline")), "offset")
    slots = written(slots, f"{path}/slots")
    if weights is None:
        horizon = slots.where(~F.col("lane").isin(*trimmed)) if trimmed else slots
        last = horizon.agg(F.max("slot")).first()[0]
    else:  # given weights hold until the first source runs out
        last = slots.groupBy("lane").agg(F.max("slot").alias("slot")).agg(F.min("slot")).first()[0]
    in_mix = F.lit(True) if last is None else ~F.col("lane").isin(*trimmed) | (F.col("slot") <= F.lit(last)) if trimmed else F.lit(True)
    return slots.select("*", in_mix.alias("in_mix"))


def mixed(docs: DataFrame, surplus: bool = False, **options) -> DataFrame:
    """The documents of the mix with all their columns, in the order of the mix.

    With ``surplus`` all documents of scheduled sources stay: the blocks of a source over its target that are not
    ``in_mix`` keep their slots, which come after the last block of the sources at their targets."""
    plan = mix_sources(docs, **options)
    plan = plan if surplus else plan.where("in_mix")
    plan = plan.groupBy("doc_id", "text_key", "source").agg(F.min("slot").alias("slot"), F.min("offset").alias("offset"))
    marked = packed(docs, id=F.col("doc_id").cast("long"), key=F.xxhash64(text_of()), origin=F.coalesce(F.col("source").cast("string"), F.lit(NO_SOURCE)))
    same = marked["id"].eqNullSafe(plan["doc_id"]) & (marked["key"] == plan["text_key"]) & (marked["origin"] == plan["source"])
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return marked.join(plan, same).repartitionByRange(n, "slot", "offset").sortWithinPartitions("slot", "offset").select("row.*")

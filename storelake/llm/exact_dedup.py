"""Exact dedup over an extendible-hash index kept on shared files (DataFrame operations only).

Texts are equal when they are equal after the six white-space characters
``[\\x20\\x09-\\x0D]`` are deleted. The key of a text is the 64-bit hash of
that normal form; the leading bits of the key choose its bucket.

1. *Directory.* Starting from one bucket, every pass splits the buckets that
   hold more than ``bucket_entries`` distinct keys by one more bit and so
   doubles the directory. Each generation is a small table in the shared folder
   (at most ``2 ** max_depth`` rows). Copies of one text have one key, so no
   number of copies makes a bucket overfull.
2. *Entries.* The directory gives every text its bucket. Copies are combined before they travel: a map-side
   aggregate on key and bytes within each of ``_SALTS`` groups of partitions, so a text with any
   number of copies reaches its owner as a few entries, each with its own count and best row.
3. *Owners.* The entries are dealt to tasks by ranges of buckets, which are ranges of keys. The owner of
   a bucket sorts the entries of one key by their bytes and chains them: equal bytes are one link
   (``chain`` 0, 1, ...), other bytes under the same key are the next. The row that stays and the size of a
   group are known only there, and the owner writes them to its index file.
4. *Probe.* Every document looks up its entry by key and digest. The probe is a
   sort-merge join of narrow rows; AQE splits a key that holds a third of them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storelake.llm.common import packed, run_dir, text_of, written

_SALTS = 8

# Fixed by the contract: the characters deleted before texts are compared.
SPACES = [" ", "\t", "\n", "\x0b", "\x0c", "\r"]


def normal_form(text):
    """The text without its white space."""
    return reduce(lambda t, c: F.replace(t, F.lit(c), F.lit("")), SPACES, text)


def grow_directory(keys: DataFrame, path: str, bucket_entries: int, max_depth: int) -> DataFrame:
    """(slot, bucket, depth): the bucket and its local depth for every slot in
    use, a slot being the leading ``max_depth`` bits of a key.

    ``bucket`` is the first slot of the bucket's range, so buckets order as
    key ranges do."""
    slot = F.shiftrightunsigned("key", 64 - max_depth).alias("slot")
    load = keys.select("key").distinct().groupBy(slot).agg(F.count("*").alias("entries"))
    directory = written(load.select("slot", "entries", F.lit(0).alias("depth"), F.lit(0).cast("long").alias("bucket")), f"{path}/directory-0")
    for depth in range(max_depth):
        overfull = directory.where(F.col("depth") == depth).groupBy("bucket").agg(F.sum("entries").alias("held")).where(F.col("held") > bucket_entries).select("bucket", F.lit(True).alias("split"))
        if overfull.isEmpty():
            break
        width = max_depth - depth - 1  # bits below the next split
        split = F.coalesce("split", F.lit(False))
        directory = written(
            # at most 2 ** max_depth buckets: bounded by the parameter
            directory.join(F.broadcast(overfull), "bucket", "left").select(
                "slot",
                "entries",
                F.when(split, depth + 1).otherwise(F.col("depth")).alias("depth"),
                F.when(split, F.shiftleft(F.shiftright("slot", width), width)).otherwise(F.col("bucket")).alias("bucket"),
            ),
            f"{path}/directory-{depth + 1}",
        )
    return directory.select("slot", "bucket", "depth")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_entries: int = 20_000, max_depth: int = 16) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256,
    n_chars, bucket, chain``.

    Of equal texts the row with the most code points in its original text,
    then the smallest id, stays. Null texts count as empty; a null id comes
    after all others. Of rows that repeat an id together with its text one is
    ``kept``. Other columns of ``docs`` are not read. An empty input gives an
    empty result."""
    spark = docs.sparkSession
    path = run_dir(spark, "exact-dedup")
    t = text_of(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), t.alias("text")).select("doc_id", F.length("text").cast("long").alias("n_chars"), normal_form(F.col("text")).alias("norm"))
    keys = written(rows.select("doc_id", "n_chars", F.xxhash64("norm").alias("key"), F.sha2("norm", 256).alias("sha")), f"{path}/keys")
    directory = grow_directory(keys, path, bucket_entries, max_depth)

    # the row that stays: most characters, ids before null, smallest id (~id falls as id grows)
    rank = F.struct("n_chars", F.col("doc_id").isNotNull().alias("has"), F.bitwise_not("doc_id").alias("inv"))
    entries = (
        rows.select(rank.alias("rank"), "norm", F.xxhash64("norm").alias("key"), F.pmod(F.spark_partition_id(), F.lit(_SALTS)).alias("salt"))
        .groupBy("key", "norm", "salt")
        .agg(F.max("rank").alias("best"), F.count("*").alias("copies"))
        .withColumn("slot", F.shiftrightunsigned("key", 64 - max_depth))
    )
    # the directory has at most 2 ** max_depth rows
    owned = entries.join(F.broadcast(directory), "slot").repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "bucket")
    along = Window.partitionBy("bucket", "key").orderBy("norm")
    index = written(
        owned.withColumn("chain", F.dense_rank().over(along) - 1)
        .groupBy("bucket", "key", "chain")
        .agg(F.max("best").alias("best"), F.sum("copies").alias("group_size"), F.first(F.sha2("norm", 256)).alias("sha"))
        .select("bucket", "key", "chain", "sha", F.bitwise_not("best.inv").alias("keep_id"), F.col("best.n_chars").alias("keep_chars"), "group_size"),
        f"{path}/index",
    )
    copies = Window.partitionBy("doc_id", "key", "sha", "n_chars").orderBy(F.lit(0))
    probe = keys.withColumn("copy", F.row_number().over(copies))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_chars") == F.col("keep_chars")) & (F.col("copy") == 1)
    return probe.join(index, ["key", "sha"]).select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.col("sha").alias("text_sha256"), "n_chars", "bucket", "chain")


def keep_first_of_equal(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that ``exact_dedup`` keeps, with all their columns.

    Null texts count as empty, null ids come last, and of rows that repeat an id and its text one
    stays; an empty table stays empty and extra columns stay, whatever their names."""
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    stay = exact_dedup(docs, **options).where("kept").select("doc_id", "text_sha256")
    t = text_of(text_col)
    marked = packed(docs, id=F.col(id_col).cast("long"), sha=F.sha2(normal_form(t), 256), size=F.length(t))
    same_row = Window.partitionBy("id", "sha").orderBy(F.desc("size"))
    one = marked.withColumn("copy", F.row_number().over(same_row)).where("copy = 1")
    same = one["id"].eqNullSafe(stay["doc_id"]) & (one["sha"] == stay["text_sha256"])
    return one.join(stay, same, "left_semi").select("row.*")

"""Structured Streaming plumbing (ST01–ST13).

* ``table_stream`` — a file-source stream over a driver table (schema from the
  parquet footer, no inference).
* ``run_to_table`` — run a streaming plan to completion with the
  ``availableNow`` trigger and return what it wrote as a batch DataFrame. The
  sink and its checkpoint live in a fresh folder under the cluster's shared
  ``spark.checkpoint.dir`` (never a machine-local folder, never the driver's
  memory), so a restarted query resumes exactly once.
* ``batch_keyed_upsert`` — a ``foreachBatch`` writer that overwrites only its
  own ``batch_id=`` partition: replaying a batch after a failure rewrites the
  same files (idempotent), and readers take the latest batch per key (G10).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storelake.session import ensure_checkpoint_dir


def table_stream(spark: SparkSession, sf_dir: str, name: str, max_files: int | None = None) -> DataFrame:
    """Stream the files of one driver table (a glob on the table file keeps
    the source's base path a directory)."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    r = spark.readStream.schema(schema)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.parquet(path[:-1] + "[t]")


def dir_stream(spark: SparkSession, path: str, schema, max_files: int | None = 1) -> DataFrame:
    """Stream a directory of parquet files (replay fixtures: one file per trigger)."""
    r = spark.readStream.schema(schema)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.parquet(path)


def run_folder(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/storelake-streams/{name}-{uuid.uuid4().hex}"


def run_to_table(stream: DataFrame, name: str, mode: str = "append", writer: Callable | None = None, partition_by: Sequence[str] = (), base: str | None = None) -> DataFrame:
    """Run ``stream`` with trigger(availableNow=True) and return the written
    result. ``mode='complete'`` rewrites the whole result each batch (used for
    aggregates whose state is bounded by their groups); ``writer`` is a
    custom ``foreachBatch(df, batch_id, out_path)`` function. ``base`` is the folder of an earlier
    run to go on with (its sink and checkpoint), else a fresh one."""
    spark = stream.sparkSession
    base = base or run_folder(spark, name)
    out, ckpt = f"{base}/out", f"{base}/_checkpoint"
    w = stream.writeStream.option("checkpointLocation", ckpt).trigger(availableNow=True)
    if writer is not None:
        w = w.outputMode(mode).foreachBatch(lambda df, bid: writer(df, bid, out))
    elif mode == "complete":
        w = w.outputMode("complete").foreachBatch(lambda df, bid: df.write.mode("overwrite").parquet(out))
    else:
        w = w.outputMode(mode).format("parquet").option("path", out)
        if partition_by:
            w = w.partitionBy(*partition_by)
    q = w.start()
    q.awaitTermination()
    exc = q.exception()
    if exc is not None:
        raise RuntimeError(f"stream {name} failed: {exc}")
    try:
        return spark.read.parquet(out)
    except Exception:  # nothing written: empty result with the stream's schema
        return spark.createDataFrame([], stream.schema)


def open_state(spark: SparkSession, base: str) -> DataFrame:
    """What the stateful operator of the stream run in ``base`` still holds after its last batch."""
    return spark.read.format("statestore").load(f"{base}/_checkpoint").select("value.*")


def run_batches(stream: DataFrame, base: str, writer: Callable, mode: str = "append") -> str:
    """Run what is there of ``stream`` through ``writer(df, batch_id, out)`` with the
    checkpoint in ``base``; returns ``out``. A second call goes on where the first ended."""
    out = f"{base}/out"
    q = stream.writeStream.option("checkpointLocation", f"{base}/_checkpoint").trigger(availableNow=True).outputMode(mode).foreachBatch(lambda df, bid: writer(df, bid, out)).start()
    q.awaitTermination()
    return out


def batch_keyed_upsert(df: DataFrame, batch_id: int, out: str) -> None:
    """foreachBatch: write this micro-batch's rows to ``out/batch_id=<id>``
    (overwrite that partition only; a replayed batch rewrites itself)."""
    df.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")


def latest_by_batch(x: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Read side of :func:`batch_keyed_upsert`: the row of the latest batch
    per key (max_by, a partial aggregate), from the rows of all batches."""
    cols = [c for c in x.columns if c not in (*keys, "batch_id")]
    return x.groupBy(*keys).agg(F.max_by(F.struct(*cols), F.col("batch_id")).alias("_v")).select(*keys, "_v.*")


def split_late(df: DataFrame, ts: str, watermark_ts) -> tuple[DataFrame, DataFrame]:
    """ST09: rows at or below the watermark are late (kept in their own table,
    never silently dropped); the rest are on time."""
    late = df.where(F.col(ts) <= F.lit(watermark_ts)) if watermark_ts is not None else df.limit(0)
    on_time = df.where(F.col(ts) > F.lit(watermark_ts)) if watermark_ts is not None else df
    return on_time, late

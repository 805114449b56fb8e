"""Sources, sinks and table jobs (§2.1, S01–S20) on files.

Writes never overwrite a path that is being read: a new version goes to a
fresh sibling folder (``rewrite_table``) and readers switch to it. All folders
are under a base chosen by the caller — on a cluster the shared
``spark.checkpoint.dir`` or a warehouse path, never a machine-local folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException


# S01 -------------------------------------------------------------------------
def read_reconciled(spark: SparkSession, sources: dict[str, str], renames: dict[str, dict[str, str]], casts: dict[str, str]) -> DataFrame:
    """Read each parquet alone (mergeSchema fails on type conflicts), rename
    and cast conflicting columns, union by name with missing columns NULL;
    ``source`` tags each row's origin."""
    out = None
    for name, path in sources.items():
        df = spark.read.parquet(path)
        for old, new in renames.get(name, {}).items():
            df = df.withColumnRenamed(old, new)
        df = df.withColumns({c: F.col(c).cast(t) for c, t in casts.items() if c in df.columns}).withColumn("source", F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


# S02 / S17 -------------------------------------------------------------------
def table_exists(spark: SparkSession, path: str) -> bool:
    """Absent source => False (callers skip it, never invent data)."""
    try:
        spark.read.parquet(path).schema  # noqa: B018 - footer read only
        return True
    except AnalysisException:
        return False


def expected_vs_found(spark: SparkSession, base: str, expected: Sequence[str]) -> DataFrame:
    """Presence and row count per expected table (counts come from parquet
    metadata; absent tables get exists = false and NULL rows)."""
    parts = []
    for name in expected:
        path = f"{base.rstrip('/')}/{name}.parquet"
        if table_exists(spark, path):
            parts.append(spark.read.parquet(path).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table_name"), F.lit(True).alias("exists"), "rows"))
        else:
            parts.append(spark.createDataFrame([(name, False, None)], "table_name string, exists boolean, rows long"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def read_table(spark: SparkSession, name: str) -> DataFrame | None:
    """A table of the catalog, None where there is none (the caller skips it)."""
    return spark.table(name) if spark.catalog.tableExists(name) else None


def catalog_scan(spark: SparkSession, expected: Sequence[str]) -> DataFrame:
    """(table_name, exists, rows) for the expected tables, looked up in the catalog by name
    (``database.table`` too; temporary views count). An absent one is reported with NULL rows."""
    parts = []
    for name in expected:
        df = read_table(spark, name)
        if df is None:
            parts.append(spark.range(1).select(F.lit(name).alias("table_name"), F.lit(False).alias("exists"), F.lit(None).cast("long").alias("rows")))
        else:
            parts.append(df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table_name"), F.lit(True).alias("exists"), "rows"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# S03 -------------------------------------------------------------------------
def write_all(spark: SparkSession, tables: dict[str, DataFrame], base: str, run_id: str) -> DataFrame:
    """Overwrite every table under ``base``, count what was written (from
    the written files, not by recomputing the plan) and append one run-log
    row per table to ``base/_run_log`` (appended, not overwritten)."""
    rows = []
    for name, df in tables.items():
        path = f"{base}/{name}"
        df.write.mode("overwrite").parquet(path)
        rows.append(spark.read.parquet(path).agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(run_id).alias("run_id"), F.lit(name).alias("table_name"), "row_count"))
    log = rows[0]
    for r in rows[1:]:
        log = log.unionByName(r)
    log = log.withColumn("generated_at", F.current_timestamp())
    log.write.mode("append").parquet(f"{base}/_run_log")
    return spark.read.parquet(f"{base}/_run_log").where(F.col("run_id") == run_id)


# S04 -------------------------------------------------------------------------
def append_evolving(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Append allowing new columns; read back with mergeSchema."""
    w = df.write.mode("append")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def read_evolving(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("mergeSchema", "true").parquet(path)


# S05 -------------------------------------------------------------------------
def rewrite_table(df: DataFrame, base: str) -> str:
    """Replace contents and schema: write to a new sibling version folder and
    return its path (the old version stays readable until readers switch)."""
    path = f"{base.rstrip('/')}/v-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    return path


# S06 / S07 / S08 / S10 ----------------------------------------------------------
# The live-event envelope fields.
ENVELOPE_FIELDS = ("event_type", "trace_id", "ingest_timestamp", "schema_version", "source", "correlation_id", "partition_key", "session_id", "parent_event_id")
TS_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def encode_envelope(df: DataFrame, event_type: Column, payload_cols: Sequence[str], ts: str, trace: Column) -> DataFrame:
    """Row -> envelope JSON {event_type, payload{...}, trace_id, ingest_timestamp, ...}."""
    env = F.struct(
        event_type.alias("event_type"),
        F.struct(*[F.col(c) for c in payload_cols]).alias("payload"),
        trace.alias("trace_id"),
        F.date_format(F.col(ts), TS_FORMAT).alias("ingest_timestamp"),
        F.lit("1.0").alias("schema_version"),
        F.lit("storelake").alias("source"),
    )
    return df.select(F.to_json(env).alias("value"))


def decode_envelope(df: DataFrame, payload_schema: str, value: str = "value") -> DataFrame:
    """JSON string -> envelope columns + typed payload columns; ISO
    timestamps parsed; ``payload.source`` renamed ``payload_source``;
    malformed rows give NULLs (PERMISSIVE), never an exception."""
    schema = f"event_type string, trace_id string, ingest_timestamp string, schema_version string, source string, payload struct<{payload_schema}>"
    e = df.select(F.from_json(F.col(value), schema).alias("e"))
    payload_fields = [f.name for f in T._parse_datatype_string(f"struct<{payload_schema}>").fields]
    cols = [F.col(f"e.payload.{f}").alias("payload_source" if f == "source" else f) for f in payload_fields]
    return e.select(
        *cols, F.col("e.event_type").alias("event_type"), F.col("e.trace_id").alias("trace_id"),
        F.to_timestamp(F.col("e.ingest_timestamp"), TS_FORMAT).cast("timestamp_ntz").alias("ingest_timestamp"), F.col("e.schema_version").alias("schema_version"),
    )


def apply_json_mapping(df: DataFrame, value: str, mapping: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Declarative ``(column, $.json.path, type)`` extraction."""
    return df.select("*", *[F.get_json_object(F.col(value), path).cast(typ).alias(col) for col, path, typ in mapping])


def unknown_events(df: DataFrame, type_col: str, known: Sequence[str]) -> DataFrame:
    """Events whose type has no mapping, payload kept whole (the
    reference skips them)."""
    spark = df.sparkSession
    k = spark.createDataFrame([(t,) for t in known], f"{type_col} string")
    return df.join(F.broadcast(k), type_col, "left_anti")


# S11 / S13 -------------------------------------------------------------------
def export_csv(df: DataFrame, columns: Sequence[str], path: str, single_file: bool = False, partitions: int | None = None) -> str:
    """Fixed column order, booleans as 0/1, a ``loaded_at`` stamp,
    RFC-4180 quoting, header. ``single_file`` coalesces to one writer."""
    sel = [F.col(c).cast("int").alias(c) if isinstance(df.schema[c].dataType, T.BooleanType) else F.col(c) for c in columns]
    out = df.select(*sel).withColumn("loaded_at", F.current_timestamp())
    if single_file:
        out = out.coalesce(1)
    elif partitions:
        out = out.repartition(partitions)
    out.write.mode("overwrite").option("header", True).option("quoteAll", False).option("escape", '"').csv(path)
    return path


def load_csv(spark: SparkSession, path: str, schema: str, columns: Sequence[str]) -> DataFrame:
    """Staged load of an exported CSV with an explicit schema, then the
    contract column order."""
    return spark.read.schema(schema).option("header", True).option("escape", '"').csv(path).select(*columns)


# S12 -------------------------------------------------------------------------
def chunked_write(df: DataFrame, keys: Sequence[str], chunks: int, base: str, writer=None) -> list[str]:
    """Deterministic hash chunks: chunk = pmod(xxhash64(keys), n), written in one pass as a folder
    a chunk. A ``writer(chunk_df, i)`` (a database target) then gets each folder, so a retried
    chunk sends exactly its own rows — a re-scan neither drops nor repeats any."""
    paths = [f"{base}/chunk={i}" for i in range(chunks)]
    tagged = df.withColumn("chunk", F.pmod(F.xxhash64(*[F.col(k) for k in keys]), F.lit(chunks)))
    tagged.write.mode("overwrite").partitionBy("chunk").parquet(base)
    if writer is not None:
        stored = df.sparkSession.read.schema(tagged.schema).parquet(base)
        for i in range(chunks):  # the folder filter prunes to one chunk
            writer(stored.where(F.col("chunk") == i).drop("chunk"), i)
    return paths


# S14 -------------------------------------------------------------------------
def conform(df: DataFrame, contract: T.StructType) -> tuple[DataFrame, DataFrame]:
    """Project to the contract order (missing columns NULL, casts applied) and
    report missing / mistyped / case-duplicate columns with what the data shows: rows, nulls, and
    values that do not survive the cast (``lost``). One aggregate over the rows."""
    have = {f.name: f.dataType for f in df.schema.fields}
    lower: dict[str, list[str]] = {}
    for n in have:
        lower.setdefault(n.lower(), []).append(n)
    issues = []
    for f in contract.fields:
        if f.name not in have:
            issues.append((f.name, "missing", f.dataType, None, F.count(F.lit(1)), F.lit(0)))
        elif have[f.name] != f.dataType:
            c = F.col(f.name)
            issues.append((f.name, "mistyped", f.dataType, have[f.name], F.count_if(c.isNull()), F.count_if(c.isNotNull() & c.try_cast(f.dataType).isNull())))
    issues += [(",".join(sorted(names)), "case_duplicate", None, None, F.lit(0), F.lit(0)) for names in lower.values() if len(names) > 1]
    projected = df.select(*[(F.col(f.name).try_cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in contract.fields])
    name = lambda t: F.lit(t.simpleString() if t else None).cast("string")
    rows = [
        F.struct(F.lit(c).alias("column"), F.lit(i).alias("issue"), name(want).alias("expected"), name(found).alias("found"), F.count(F.lit(1)).alias("rows"), nulls.cast("long").alias("nulls"), lost.cast("long").alias("lost"))
        for c, i, want, found, nulls, lost in issues
    ]
    none = "array<struct<column:string,issue:string,expected:string,found:string,rows:long,nulls:long,lost:long>>"
    report = df.agg((F.array(*rows) if rows else F.array()).cast(none).alias("x")).select(F.explode("x").alias("x")).select("x.*")
    return projected, report


# S15 / S16 -------------------------------------------------------------------
def compact_and_cluster(df: DataFrame, cols: Sequence[str], target_rows: int, base: str) -> str:
    """Re-aimed OPTIMIZE/ZORDER: range-partition on the query columns into
    files of about ``target_rows`` rows, sort within each, write a new version (swap)."""
    files = max(1, -(-df.count() // target_rows))
    out = df.repartitionByRange(files, *[F.col(c) for c in cols]).sortWithinPartitions(*cols)
    return rewrite_table(out, base)


def apply_retention(df: DataFrame, ts: str, days: int) -> DataFrame:
    """Keep rows with ts > max(ts) - days (anchored to the data, not now())."""
    m = df.agg(F.max(ts)).first()[0]
    if m is None:
        return df
    return df.where(F.col(ts) > F.lit(m) - F.expr(f"INTERVAL {int(days)} DAYS"))

"""Storage of incrementally kept views: parts of micro-batches, merged by generations.

Every micro-batch adds one part (its own partial aggregate). Parts are named by a manifest; whenever
``FANOUT`` parts of one generation are live they are merged into one part of the next, so after n batches at most
(FANOUT - 1) * log_FANOUT(n) + 1 parts are read, and each row is rewritten that many times at most.

A manifest is a small file with a version number, written under another name and renamed, so readers see the old
set of parts or the new one and never half of it. Parts that a manifest no longer names are deleted when the manifest
after it is written: who has just read the older one can still read its parts.

A batch that is replayed rewrites its own part, or does nothing if the part was merged already. There is one writer
a view (the streaming query that owns it).
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

FANOUT = 8
Merge = Callable[[DataFrame], DataFrame]


def _files(spark: SparkSession, path: str):
    """The Hadoop file system of ``path`` and the path in its form."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p, jvm.org.apache.hadoop.fs.Path


def _versions(spark: SparkSession, base: str) -> list[int]:
    fs, p, _ = _files(spark, f"{base}/manifest")
    if not fs.exists(p):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(p)]
    return sorted(int(n) for n in names if n.isdigit())


def _manifest(spark: SparkSession, base: str, version: int) -> list[dict]:
    return json.loads(spark.read.text(f"{base}/manifest/{version:012d}", wholetext=True).first()[0])


def live_parts(spark: SparkSession, base: str) -> list[dict]:
    """Parts of the view: path, generation, first and last batch."""
    versions = _versions(spark, base)
    return _manifest(spark, base, versions[-1]) if versions else []


def _publish(spark: SparkSession, base: str, parts: list[dict]) -> None:
    versions = _versions(spark, base)
    version = versions[-1] + 1 if versions else 0
    fs, _, path = _files(spark, base)
    draft, final = path(f"{base}/manifest/_{version:012d}"), path(f"{base}/manifest/{version:012d}")
    out = fs.create(draft, True)
    out.write(bytearray(json.dumps(parts).encode()))
    out.close()
    if not fs.rename(draft, final):
        raise RuntimeError(f"manifest {version} of {base} exists already: a view has one writer")
    if len(versions) > 1:  # what only the manifest before the last one named
        named = {e["path"] for e in parts} | {e["path"] for e in _manifest(spark, base, versions[-1])}
        for e in _manifest(spark, base, versions[-2]):
            if e["path"] not in named:
                fs.delete(path(e["path"]), True)
        fs.delete(path(f"{base}/manifest/{versions[-2]:012d}"), False)


def commit(df: DataFrame, batch_id: int, base: str, merge: Merge, fanout: int = FANOUT, use: Callable[[str, list[str]], None] | None = None) -> None:
    """Add the part of batch ``batch_id`` (``merge`` of its rows) to the view at ``base``. ``use`` gets the paths of the written
    part and of the other live ones before a manifest names the part."""
    spark = df.sparkSession
    parts = live_parts(spark, base)
    if any(e["generation"] and e["first"] <= batch_id <= e["last"] for e in parts):
        return
    path = f"{base}/parts/0-{batch_id}"
    merge(df).write.mode("overwrite").parquet(path)
    parts = [e for e in parts if e["path"] != path]
    if use:
        use(path, [e["path"] for e in parts])
    parts += [{"path": path, "generation": 0, "first": batch_id, "last": batch_id}]
    generation, made = 0, [path]
    while len(full := [e for e in parts if e["generation"] == generation]) >= fanout:
        first, last = min(e["first"] for e in full), max(e["last"] for e in full)
        path = f"{base}/parts/{generation + 1}-{first}-{last}"
        merge(spark.read.schema(df.schema).parquet(*(e["path"] for e in full))).write.mode("overwrite").parquet(path)
        parts = [e for e in parts if e["generation"] != generation] + [{"path": path, "generation": generation + 1, "first": first, "last": last}]
        generation += 1
        made.append(path)
    _publish(spark, base, parts)
    for path in made[:-1]:  # merged on before any manifest named it
        fs, p, _ = _files(spark, path)
        fs.delete(p, True)


def read_view(spark: SparkSession, base: str, schema, merge: Merge) -> DataFrame:
    """The view: ``merge`` over its live parts. A single part is a merge already."""
    parts = live_parts(spark, base)
    if len(parts) == 1:
        return spark.read.schema(schema).parquet(parts[0]["path"])
    return merge(spark.read.schema(schema).parquet(*(e["path"] for e in parts)) if parts else spark.createDataFrame([], schema))

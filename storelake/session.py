"""Session helpers.

On a cluster the session is built by the platform; these helpers only fill in
settings that are unset, so the cluster's own choices (shuffle partitions,
checkpoint directory, memory) always win.
"""

from __future__ import annotations

import math
import os
import tempfile
from collections.abc import Sequence

from pyspark.sql import SparkSession

# Settings every plan in this package assumes. AQE re-plans joins from runtime
# sizes (broadcast only when the built side is measured small), coalesces small
# shuffle partitions and splits skewed ones.
_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32m",
    "spark.sql.files.maxPartitionBytes": "32m",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8, app: str = "storelake") -> SparkSession:
    """Local session for tests and the bench (UI off, no server ports)."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("STORELAKE_DRIVER_MEM", "16g"))
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    for k, v in _DEFAULTS.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    configure(spark)
    return spark


def configure(spark: SparkSession) -> SparkSession:
    """Apply package defaults only where the session leaves them unset."""
    for k, v in _DEFAULTS.items():
        if k in ("spark.sql.session.timeZone",):
            spark.conf.set(k, v)  # results are defined in UTC
            continue
        try:
            cur = spark.conf.get(k, None)
        except Exception:  # pragma: no cover - conf read refused
            cur = None
        if cur is None:
            spark.conf.set(k, v)
    ensure_checkpoint_dir(spark)
    return spark


_INITIAL = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
#: Bytes of the tables behind one initial shuffle partition.
PARTITION_BYTES = 8 << 20
_sized: dict[str, str] = {}


def size_shuffles(spark: SparkSession, sf_dir: str | None = None, tables: Sequence[str] = ()) -> None:
    """Let the initial number of shuffle partitions grow with the bytes of ``tables``, so that what one task sorts
    or holds does not; AQE merges small ones again. Never fewer than the session's shuffle partitions. Without
    ``sf_dir`` an earlier number is taken back; a number the session has set itself stays."""
    app = spark.sparkContext.applicationId
    now = spark.conf.get(_INITIAL, None)
    if now is not None and now != _sized.get(app):
        return
    n = math.ceil(_bytes(spark, sf_dir, tables) / PARTITION_BYTES) if sf_dir else 0
    if n > int(spark.conf.get("spark.sql.shuffle.partitions")):
        _sized[app] = str(n)
        spark.conf.set(_INITIAL, n)
    elif now is not None:
        spark.conf.unset(_INITIAL)


def _bytes(spark: SparkSession, sf_dir: str, tables: Sequence[str]) -> int:
    """Bytes of those of ``tables`` that are there."""
    conf, path = spark._jsc.hadoopConfiguration(), spark._jvm.org.apache.hadoop.fs.Path
    paths = [path(f"{sf_dir.rstrip('/')}/{t}.parquet") for t in tables]
    return sum(fs.getContentSummary(p).getLength() for p in paths if (fs := p.getFileSystem(conf)).exists(p))


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the cluster (spark.checkpoint.dir)."""
    return ensure_checkpoint_dir(spark)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's spark.checkpoint.dir. Only a session that runs in one process
    (``local[...]``: tests, the bench) may go without; it gets a scratch folder. On a
    cluster a folder of one machine would lose data, so there it is an error."""
    sc = spark.sparkContext
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not d:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        d = tempfile.mkdtemp(prefix="storelake-ckpt-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", d)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(d)
    return d

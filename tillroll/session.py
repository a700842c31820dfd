"""SparkSession helpers.

Everything here is ordinary session configuration: AQE (runtime coalescing,
skew-join splitting, runtime broadcast of small sides) and a checkpoint
directory that is read from the session and only set when the cluster left
it unset (tests, local runs).
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

ROWS_A_PART = 200_000

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str | None = None, app: str = "tillroll",
                  shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    """Create (or reuse) a session with the library's defaults."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def app_key(spark: SparkSession) -> str:
    """Identifier of the running application (for per-session table caches)."""
    try:
        return spark.conf.get("spark.app.id")
    except Exception:  # pragma: no cover - conf without an app id
        return str(id(spark))


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared checkpoint folder named by the cluster (``spark.checkpoint.dir``).

    Only when a local session leaves it unset (tests) a scratch folder is created
    and registered; on a cluster the configured shared path is used, and a session
    without one is refused, for executors would not see each other's files.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # e.g. a Spark Connect session: no driver-side context
        sc = None
    current = sc.getCheckpointDir() if sc is not None else None
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if conf_dir:
        if sc is not None:
            sc.setCheckpointDir(conf_dir)
        return conf_dir
    if not spark.conf.get("spark.master", "local").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    local = tempfile.mkdtemp(prefix="tillroll-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    if sc is not None:
        sc.setCheckpointDir(local)
    spark.conf.set("spark.checkpoint.dir", local)
    return local


def parts_for(spark: SparkSession, rows: int) -> int:
    """Hash partitions of a table of ``rows`` wide rows: a few MB each, so no aggregation of one spills at any input size."""
    return min(max(spark.sparkContext.defaultParallelism, -(-rows // ROWS_A_PART)), 100_000)


def materialize(df, name: str = "table", partition_by: list[str] | None = None, buckets: tuple[int, str] | None = None,
                options: dict[str, str] | None = None):
    """Cut lineage at a table boundary by writing a Parquet table.

    ``buckets``: (number, column) of a bucketed table; rows of one value are read by one task, so aggregations and
    joins by that column need no shuffle. ``df`` should be partitioned alike (``repartition(number, column)``).
    ``options``: of the Parquet writer.

    The table goes to a fresh folder under the shared checkpoint directory
    (``checkpoint_dir``) and is read back: downstream stages re-read it instead
    of re-planning and re-running the upstream plan, a lost executor does not
    force recomputation from the sources, and the re-read gets column pruning
    and filter pushdown. Unlike an RDD checkpoint of an unpersisted frame the
    data are computed once. Never a local (executor-memory) checkpoint.
    """
    import uuid
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/tables/{name}-{uuid.uuid4().hex[:12]}"
    w = df.write.mode("overwrite").options(**(options or {}))
    if partition_by:
        w = w.partitionBy(*partition_by)
    if buckets:
        table = f"tillroll_{name}_{uuid.uuid4().hex[:12]}".replace("-", "_")
        w.bucketBy(*buckets).format("parquet").option("compression", "zstd").option("path", path).saveAsTable(table)
        return spark.table(table)
    w.parquet(path)
    return spark.read.schema(df.schema).parquet(path)  # no job to infer the schema

"""Shared scratch space: how operators cut lineage.

Intermediate tables are written as Parquet below the folder named by
``spark.checkpoint.dir``, which driver and executors share on a cluster.  Only
where that setting is absent in a local session (a test) is a temporary local
folder made; on a cluster its absence is an error, for executors would write to
disks of their own.  Tables live until the application ends.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
_MADE: list[tuple[SparkSession, str]] = []


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of this session, as a path that Spark opens."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = current.get() if current.isDefined() else None
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        if app not in _LOCAL:
            _LOCAL[app] = tempfile.mkdtemp(prefix="marginalia-")
        root = _LOCAL[app]
    return f"{root.rstrip('/')}/marginalia-{spark.sparkContext.applicationId}"


def _drop_all() -> None:
    for spark, path in _MADE:
        try:
            drop_path(spark, path)
        except Exception:  # the session has ended already; the folder goes with it
            return


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder through Spark's own file system layer."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to shared scratch and read it back, without its lineage."""
    spark = df.sparkSession
    if not _MADE:
        atexit.register(_drop_all)
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    _MADE.append((spark, path))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(df: DataFrame) -> None:
    """Drop the scratch files behind a materialised table that nothing reads again."""
    spark = df.sparkSession
    root = scratch_root(spark)
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if f"/marginalia-{spark.sparkContext.applicationId}/" in path:
            drop_path(spark, path)

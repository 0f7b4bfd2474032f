"""Session helpers: recommended settings and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

RECOMMENDED_CONF = {
    # Let AQE coalesce small shuffles, split skewed joins and pick broadcast by measured size.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # 4992-sample records are ~10 KB each: 512 rows keep an Arrow batch near 5 MB, inside a core's cache.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "512",
    # A vector of 4096 payloads would be 40 MB per column; 256 keep the Parquet reader in cache too.
    "spark.sql.parquet.columnarReaderBatchSize": "256",
    # Rows carrying sample payloads: 64 MB splits keep a task's working set small.
    "spark.sql.files.maxPartitionBytes": "67108864",
}


def apply_recommended(builder: SparkSession.Builder) -> SparkSession.Builder:
    for key, value in RECOMMENDED_CONF.items():
        builder = builder.config(key, value)
    return builder


_local_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """Root of the folder every executor can reach.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session (tests, one machine) may leave it unset and then
    gets a fresh folder of its own; on a cluster that would be another disk for each executor, so it is refused.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured
    context = spark.sparkContext
    master = context.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if context.applicationId not in _local_folders:
        _local_folders[context.applicationId] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _local_folders[context.applicationId]


def new_folder(spark: SparkSession, name: str) -> str:
    """A path, not yet existing, for one written table or one stream's state."""
    return f"{shared_folder(spark).rstrip('/')}/beamfold-{name}-{uuid.uuid4().hex}"


def delete_folder(spark: SparkSession, folder: str) -> None:
    """Remove a written table that nothing reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write a narrow intermediate once to the shared folder and read it back.

    Operators that look at the same rows several times stage the few columns they need, so their
    input is computed once and a lost executor costs a re-read, not a recomputation.
    """
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

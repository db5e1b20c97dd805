"""Session settings and the shared folder that intermediate tables are written to."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Whether a query removes its shuffle files when it ends.
CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_local_dirs: dict[str, str] = {}


def build_session(app_name: str = "junctura", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the plans here rely on; keyword pairs override them."""
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        # Keeps small tables in as many files as there are cores; larger ones are not concerned.
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "32KB",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only in local mode."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    if context.applicationId not in _local_dirs:
        _local_dirs[context.applicationId] = tempfile.mkdtemp(prefix="junctura-")
    return _local_dirs[context.applicationId]


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and return the written table.

    This cuts lineage, lets later passes prune columns, survives lost executors and tells
    the planner the real size, so that it broadcasts the table only when that is small. What was
    shuffled for it goes with the write, rather than when the driver next collects its garbage.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/staged/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    kept = spark.conf.get(CLEANED, "false")
    spark.conf.set(CLEANED, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANED, kept)
    return spark.read.schema(df.schema).parquet(path)


def discard(written: DataFrame) -> None:
    """Remove a table that :func:`stage` wrote and that nothing reads any more."""
    spark = written.sparkSession
    own = f"/staged/{spark.sparkContext.applicationId}/"
    for folder in {path.rpartition("/")[0] for path in written.inputFiles()}:
        if own in folder:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

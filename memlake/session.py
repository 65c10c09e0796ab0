"""Session settings and the one place where lineage is cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
_SPARKS_OWN = "10000"


def local_session(name: str = "memlake", cpus: str = "8", memory: str = "12g") -> SparkSession:
    """A local session for tests and the benchmark; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]").appName(name)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def short_batches(spark: SparkSession) -> None:
    """Texts go to Python a thousand at a time, where the session leaves Spark's own 10,000.

    A batch is held several times over on both sides, so of long texts the larger
    one takes hundreds of megabytes more in every executor.
    """
    if spark.conf.get(_BATCH_ROWS) == _SPARKS_OWN:
        spark.conf.set(_BATCH_ROWS, "1000")


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names.

    A machine-local folder is used only where the setting is absent and the
    session is local; a cluster without a shared folder gets an error instead.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if found is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        found = tempfile.mkdtemp(prefix="memlake-ckpt-")
        sc.setCheckpointDir(found)
    return found


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder: computed once, lineage cut, used as often as wanted."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/memlake/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage in the shared folder."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()

"""Session settings every job of this package expects."""

from __future__ import annotations

import gc
import os
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings that hold on a laptop and on a cluster alike.  Parallelism is left to
# the caller: `local[8]` in tests, the cluster's own defaults elsewhere.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot join key even where that costs one more exchange afterwards.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Spark compares this with bytes as files and shuffles hold them, compressed.  Paths and names there are a fiftieth
    # of the hash table that the driver builds of them, so the default of 10 MB is a few hundred MB of its heap for one join.
    "spark.sql.autoBroadcastJoinThreshold": "1m",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "1m",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Checkpoint files go when nothing refers to them any more.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(app: str = "codeaudit", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session somebody else created."""
    for key, value in DEFAULTS.items():
        if key.startswith("spark.sql."):
            spark.conf.set(key, value)
    return spark


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it.

    It comes from `spark.checkpoint.dir`; only where neither that nor a
    programmatic folder is set (tests) a temporary one is made.
    """
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            import tempfile

            folder = tempfile.mkdtemp(prefix="checkpoint-", dir=os.environ.get("TMPDIR", "/tmp"))
        sc.setCheckpointDir(folder)
    return spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A path for a new folder below the one that all executors share."""
    return f"{checkpoint_folder(spark).rstrip('/')}/{name}-{uuid.uuid4()}"


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage through the reliable checkpoint folder of the session."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def settle(df: DataFrame) -> DataFrame:
    """`checkpoint`, after which the shuffle files and checkpoints that only earlier steps needed are deleted.

    Spark deletes files of data that nothing refers to when the driver collects its garbage, which a driver of much memory
    may not do before the job ends: a plan of many such steps would fill the disks with what none of them reads again.
    Python tells the JVM up to a second late what it holds no more, so files of `df` itself may stay until the next step.
    """
    sc = df.sparkSession.sparkContext
    out = checkpoint(df)
    del df
    gc.collect()
    sc._jvm.System.gc()
    return out


def stored_columns(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage through compressed columns below the shared folder: for a wide table of which each later step reads a few columns."""
    folder = shared_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def shuffle_widely(spark: SparkSession, partitions: int) -> None:
    """Let shuffles start with that many partitions at least, so that a task sorts what it can hold; AQE merges small ones.

    The session's number is only raised: a later, shorter table is none the worse for it.
    """
    name = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    if partitions > int(spark.conf.get(name, None) or spark.conf.get("spark.sql.shuffle.partitions")):
        spark.conf.set(name, str(partitions))


def compile_in_pieces(spark: SparkSession) -> None:
    """Let Spark split generated code that the JVM would not compile: it interprets methods above 8,000 bytes, for ever.

    Spark's own limit of 65,535 bytes lets one method of all rules through. The session's limit is only lowered.
    """
    name = "spark.sql.codegen.hugeMethodLimit"
    if int(spark.conf.get(name)) > 8000:
        spark.conf.set(name, "8000")


def spread(df: DataFrame, partitions: int | None) -> DataFrame:
    """Deal the rows out over `partitions` tasks before heavy per-row work; None keeps the splits of the input.

    A table of a few row groups is read by a few tasks, however long each row takes.
    """
    return df if partitions is None else df.repartition(partitions)

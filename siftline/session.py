"""Session settings and lineage cuts shared by every job."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # The JVM does not compile methods beyond this size; wide builders run faster
    # as split functions than as one interpreted method.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # Bytes that a charset does not know are replaced; they never end a job.
    "spark.sql.legacy.codingErrorAction": "true",
    # The state of open captures may outgrow an executor's heap.
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # Attribute maps are laid over each other: the later value of a key wins.
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
}


def configure(spark: SparkSession) -> SparkSession:
    """Set the runtime options the jobs rely on; cluster sizing is left alone."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: str = "*", shuffle_partitions: int = 8, shared: str | None = None) -> SparkSession:
    """Session for tests and the local benchmark; `shared` is the folder that a
    cluster names in `spark.checkpoint.dir`."""
    builder = SparkSession.builder if shared is None else SparkSession.builder.config("spark.checkpoint.dir", shared)
    spark = (
        builder.master(f"local[{cores}]")
        .appName("siftline")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        # Tests read the filters in plans, which are else cut after 100 characters.
        .config("spark.sql.maxMetadataStringLength", "5000")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise `df` in the shared checkpoint folder so that a lost executor
    costs one stage, not the whole history of an iterative job."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession, "checkpoints"))
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder name for intermediate tables, below the shared folder the
    session names in `spark.checkpoint.dir`. Where that is unset, a temporary one
    serves a local session (tests); on a cluster the executors would not see it."""
    root = spark.conf.get("spark.checkpoint.dir", "")
    if root:
        return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{tempfile.mkdtemp(prefix=f'siftline-{name}-')}/{uuid.uuid4().hex}"

"""Session settings and the shared scratch folder."""

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Rows differ from a few bytes to a long file: bytes bound an Arrow batch. The
# values are those of every operator here, as plans run after they are made.
RUNTIME_CONF = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "100000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20),
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings every job here relies on."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: str | int = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("pairloom")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "12g")
    )
    return tune(builder.getOrCreate())


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named in ``spark.checkpoint.dir``.

    Only a local master may fall back to a folder of this machine; on a
    cluster other executors could not read it.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        folder = tempfile.mkdtemp(prefix="pairloom-")
        context.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, label: str) -> str:
    return os.path.join(scratch_root(spark), "pairloom", f"{label}-{uuid.uuid4().hex}")


def spread(df: DataFrame) -> DataFrame:
    """Enough tasks for a table with fewer splits than cores. A large table has them: it is not shuffled."""
    tasks = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= tasks else df.repartition(tasks)


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as parquet in the scratch folder and read it back.

    Cuts the lineage, survives executor loss, and unlike a cached plan keeps
    column pruning for the readers.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)

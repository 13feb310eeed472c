"""The shared folder: where lineage is cut, on every cluster in the folder that spark.checkpoint.dir names."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; in a local session without one, as in tests, a folder of its own."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="tessera-")
        sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and read from the shared folder from then on."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shuffled(rows: DataFrame) -> DataFrame:
    """rows, to be joined by a shuffle. What made the rows of a cut is not seen again, and rows that were exploded or parsed
    look as small as what they came from: the driver would gather them all to send them to the tasks."""
    return rows.hint("merge")


def small_batches(spark: SparkSession, most: int = 4 << 20) -> None:
    """Arrow batches of fewer bytes than Spark's default, for columns of whole texts or their words: a task holds a batch
    several times, in the JVM and in Python. A smaller setting stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name)) <= most:
        spark.conf.set(name, f"{most}b")


def tasks(spark: SparkSession) -> int:
    """Parts for a step that needs more room or time than its bytes tell: the session's, which are not joined afterwards."""
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))

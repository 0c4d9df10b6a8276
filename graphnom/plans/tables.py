"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from graphnom.sources.writers import remove


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where it is unset, only a session in local mode, as in tests, gets a
    folder of its own: on a cluster each executor would write to its own disk."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if folder:
        return folder
    if not sc.master.split("[")[0] == "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="graphnom-checkpoint-"))
    return sc.getCheckpointDir()


#: Bytes of input for which a table gets one more part, and parts a core that it may have in any case.
PART_BYTES, PARTS_A_CORE = 4 << 20, 4


def few_parts(df: DataFrame) -> DataFrame:
    """df in as many parts as what it reads asks for, where a small table would be written in very many. A task that
    writes to a local folder starts a process for each file and folder of its own (chmod, where Hadoop has no native
    library), and while it starts, the system counts the executor's memory twice."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    read = sum(int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size()))
    return df.coalesce(max(PARTS_A_CORE * df.sparkSession.sparkContext.defaultParallelism, min(-(-read // PART_BYTES), 1 << 20)))


def materialise(df: DataFrame) -> DataFrame:
    """df written as Parquet where spark.checkpoint.dir says, and read back. The tables of a session stand in one
    folder, which `clear` removes."""
    spark = df.sparkSession
    path = f"{run_folder(spark)}/table-{uuid.uuid4().hex}"
    few_parts(df).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def discard(*frames: DataFrame) -> None:
    """Removes the tables that `materialise` has written for these very frames; nothing may read them any more."""
    for df in frames:
        if path := getattr(df, "_written", None):
            remove(df.sparkSession, path)


def free(spark: SparkSession) -> None:
    """Lets go of shuffle files that no frame needs: executors keep them until the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def run_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/graphnom-{spark.sparkContext.applicationId}"


def clear(spark: SparkSession) -> None:
    """Removes the tables that this session's runs have written; frames that read them are of no use after it."""
    remove(spark, run_folder(spark))

"""Session helpers that behave alike in tests and on a cluster."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Where none is named, a session in one process (tests) gets a folder of its machine; on a cluster that is an error,
    as executors couldn't read each other's files.
    """
    sc = spark.sparkContext
    known = sc._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None and not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="lodestar-ckpt-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder, so that a lost executor loses no work.

    Spark deletes the files with the table where ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """``df`` as a compressed table in the shared checkpoint folder, for wide rows; it is deleted when the program ends."""
    path = shared_folder(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shared_folder(spark: SparkSession) -> str:
    """The path of a new folder among the shared ones; it is deleted when the program ends."""
    path = f"{ensure_checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    try:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session has ended; its folder goes with the cluster's
        pass


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def join_by_weight(rows: DataFrame, keyed: DataFrame, on: list[str], weight: str, parts: int = 1000, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``keyed``, which has one row per key and in ``weight`` how many rows have that key at most.

    Keys that make up more than 1/parts of all weight, of which there are fewer than ``parts``, are sent to all tasks, so
    none of their rows move; for the rest Spark joins as it sees fit, and no task meets more than that share of one
    key. Both tables are read twice: give tables that are kept. ``how`` is inner or left.
    """
    total = keyed.agg(F.coalesce(F.sum(weight), F.lit(0)).alias("t")).first().t
    heavy, light = keyed.where(F.col(weight) * parts > total), keyed.where(F.col(weight) * parts <= total)
    few = F.broadcast(heavy)
    return rows.join(few, on).unionByName(rows.join(F.broadcast(heavy.select(*on)), on, "left_anti").join(light, on, how))

"""Session set-up and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "tastegrid", cores: str | int = "*", **conf) -> SparkSession:
    """A local session for tests and benches; on a cluster the caller brings its own."""
    settings = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.driver.memory": "12g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        **conf,
    }
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir`` where the cluster
    names one. Only a local session, which has no other machine to share with, may
    fall back to a temporary folder."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    current = sc.getCheckpointDir()
    if not named and not current and not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    base = named or current or tempfile.mkdtemp(prefix="tastegrid-")
    if base.startswith("file:") and sc.master.startswith(("yarn", "k8s", "spark:")):
        raise RuntimeError("spark.checkpoint.dir names a folder of one machine")
    if not current:
        sc.setCheckpointDir(base)
    return base


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")


_STAGED: list[str] = []


def kept_path(spark: SparkSession, name: str) -> str:
    """A fresh path that ``drop_stages`` deletes."""
    _STAGED.append(scratch_path(spark, name))
    return _STAGED[-1]


# Deletes the shuffle files of a write as it ends; else they stay until the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write a table used more than once to the shared folder and read it back. Cuts the
    lineage, survives lost executors, and gives later joins real sizes to plan with. The shuffle
    files of the write are deleted, as nothing reads them again."""
    spark = df.sparkSession
    path = kept_path(spark, name)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def drop_stage(*tables: DataFrame) -> None:
    """Delete staged tables that nothing will read again, within a job that stages many; each is what ``stage`` gave."""
    for df in tables:
        drop_path(df.sparkSession, df._staged)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete what is below a path of ``kept_path``."""
    _STAGED.remove(path)
    _delete(spark, path)


def drop_stages(spark: SparkSession) -> int:
    """Delete the tables staged so far, once the results that read them are written."""
    n = len(_STAGED)
    while _STAGED:
        _delete(spark, _STAGED.pop())
    return n

"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """This application's folder in the place that all executors share; it goes when the application ends.

    The place is spark.checkpoint.dir. Only a local master may do without that setting: its executors share the machine.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if root is None:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="tidemark-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(root)
    folder = f"{root}/tidemark-{sc.applicationId}"
    if folder not in _made:
        path = sc._jvm.org.apache.hadoop.fs.Path(folder)
        files = path.getFileSystem(sc._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        _made.add(folder)
    return folder


#: Folders of this process's applications that exist already.
_made: set[str] = set()


def written(df: DataFrame, path: str) -> None:
    """Write ``df``; its shuffle files go as soon as it is written, since from then on the written table is read."""
    conf, name = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(name, None)
    conf.set(name, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            conf.unset(name)
        else:
            conf.set(name, before)


def durable(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: lineage ends here, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    written(df, path)
    return spark.read.schema(df.schema).parquet(path)


_kept: dict[tuple[str, str], str] = {}


def kept(spark: SparkSession, name: str, make) -> DataFrame:
    """The table ``make()``, written once an application and read from then on; ``name`` says what it was made from.

    Its sources must not change while the application runs.
    """
    key = (spark.sparkContext.applicationId, name)
    if key not in _kept:
        df = make()
        path = f"{shared_folder(spark)}/kept-{uuid.uuid4().hex}"
        written(df, path)
        _kept[key] = path
    return spark.read.parquet(_kept[key])

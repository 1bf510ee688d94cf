"""Sessions, input tables and lineage cuts shared by all operators."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", **conf: str) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("loomgraph")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Gives the package to Python workers that couldn't import it: neither PYTHONPATH nor their working folder has it."""
    context, root = spark.sparkContext, Path(__file__).resolve().parents[1]
    known = [Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root in known or (context.master.startswith("local[") and Path.cwd() == root) or getattr(context, "_loomgraph", False):
        return
    package = shutil.make_archive(f"{tempfile.mkdtemp(prefix='spark-loomgraph-')}/loomgraph", "zip", root, "loomgraph")
    context.addPyFile(package)  # the driver serves the file to all executors
    context._loomgraph = True


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table `name` of an input folder."""
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(frame: DataFrame) -> DataFrame:
    """Rows of fewer partitions than there are cores, such as those of one small file, divided evenly over the cores."""
    cores = frame.sparkSession.sparkContext.defaultParallelism
    return frame.repartition(cores) if frame.rdd.getNumPartitions() < cores else frame


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, a temporary one only on a single machine."""
    context = spark.sparkContext
    found = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spark-loomgraph-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(found)
    return context.getCheckpointDir()


class Cut:
    """A DataFrame written to the shared folder and read again, so that its lineage ends there.

    The files survive the loss of executors. `drop()` deletes them once no later step reads them. What a lazy result
    still reads is dropped by `release()`, which the owner of the result calls after reading it, or at the end of the program.
    """

    live: dict[str, Cut] = {}

    def __init__(self, frame: DataFrame):
        spark = frame.sparkSession
        self.path = f"{shared_folder(spark)}/cut-{uuid.uuid4().hex}"
        self.kept = False
        Cut.live[self.path] = self
        frame.write.parquet(self.path)
        # the schema is known, so reading again needs no job to infer it
        self.df = spark.read.schema(frame.schema).parquet(self.path)

    def keep(self) -> Cut:
        """`release()` leaves it, as it belongs to the session."""
        self.kept = True
        return self

    def _files(self):
        spark = self.df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(spark._jsc.hadoopConfiguration()), path

    def exists(self) -> bool:
        """False once the files are gone, such as when the owner of the folder cleared it."""
        files, path = self._files()
        return files.exists(path)

    def drop(self) -> None:
        Cut.live.pop(self.path, None)
        files, path = self._files()
        files.delete(path, True)


def cut(frame: DataFrame) -> DataFrame:
    """`Cut` for results that are needed until the end of the query."""
    return Cut(frame).df


def release(everything: bool = False) -> int:
    """Deletes the tables of results that have been read by now, also the session's own if `everything`; their number."""
    dropped = [x for x in list(Cut.live.values()) if everything or not x.kept]
    for x in dropped:
        try:
            x.drop()
        except Exception:  # the session has ended: a local folder can still be cleared
            shutil.rmtree(x.path.removeprefix("file:"), ignore_errors=True)
    return len(dropped)


atexit.register(release, True)

"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import reach_workers

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where that is unset, a temporary one made once, in local mode only.

    Elsewhere each executor would write to its own disk, so an unset folder is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", master := spark.sparkContext.master):
        raise RuntimeError(f"set spark.checkpoint.dir to a folder that the driver and all executors of {master} share")
    if "dir" not in _own:
        _own["dir"] = tempfile.mkdtemp(prefix="canopyql-")
        atexit.register(shutil.rmtree, _own["dir"], True)
    return "file://" + _own["dir"]


def _folder(spark: SparkSession, path: str) -> tuple:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


class Scratch:
    """Tables written once and read again, so that a lost executor costs no recomputation of what stands before."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.n = reach_workers(spark), f"{shared_dir(spark)}/{uuid.uuid4().hex}", 0
        # results are read lazily, so their tables stay as long as the driver runs; Hadoop deletes them when its JVM ends, on any file system
        files, folder = _folder(self.spark, self.root)
        files.mkdirs(folder)
        files.deleteOnExit(folder)
        if self.root.startswith(("file:", "/")):
            atexit.register(shutil.rmtree, "/" + self.root.removeprefix("file:").lstrip("/"), True)

    def save(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that no later plan reads."""
        for t in tables:
            files, folder = _folder(self.spark, t._scratch_path)
            files.delete(folder, True)

"""Cutting lineage through storage that every executor can read.

The cluster names its shared folder in ``spark.checkpoint.dir``.  Only a session that
runs in one process (``local[...]``, as in tests) may do without the setting: there a
temporary folder is made and set.  Anywhere else its absence is an error, since a
folder of one machine cannot be read by the executors of another.
"""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a new temporary one if a local session has none. Raises RuntimeError for a cluster without the setting."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    current = sc._jsc.sc().getCheckpointDir()
    if current.isEmpty():
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = named or "file://" + tempfile.mkdtemp(prefix="kinomill-")
        sc.setCheckpointDir(named)
        current = sc._jsc.sc().getCheckpointDir()
    return named or current.get()


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder, so that a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def release(spark: SparkSession) -> None:
    """Has the driver collect its garbage, whereupon Spark removes shuffle files and checkpoints that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _file_system(spark: SparkSession, path: str):
    """The file system of ``path``, and the path as it names it."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def remove_path(spark: SparkSession, path: str) -> None:
    """Deletes ``path`` and what is below it; nothing happens if it is absent."""
    files, target = _file_system(spark, path)
    files.delete(target, True)


def exists(spark: SparkSession, path: str) -> bool:
    files, target = _file_system(spark, path)
    return files.exists(target)


def list_path(spark: SparkSession, path: str) -> list[str]:
    """Names in the folder ``path``, none if it is absent."""
    files, target = _file_system(spark, path)
    return [status.getPath().getName() for status in files.listStatus(target)] if files.exists(target) else []


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file that is there whole or not at all: it is written under another name and moved."""
    files, target = _file_system(spark, path)
    part = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}.part-{uuid.uuid4().hex}")
    out = files.create(part, True)
    out.write(bytearray(text.encode()))
    out.close()
    if not files.rename(part, target):
        raise OSError(f"could not move a file to {path}")


def read_text(spark: SparkSession, path: str) -> str:
    files, target = _file_system(spark, path)
    stream = files.open(target)
    text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    stream.close()
    return text

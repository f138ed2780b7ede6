"""Intermediate tables in the folder that the driver and all executors share, and small files that appear whole or not at all."""

from __future__ import annotations

import os
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; only a local session, which is one process, may do without."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder and spark.sparkContext.master.startswith("local["):
        folder = spark.conf.get("spark.sql.warehouse.dir") + "/_scratch"
    if not folder:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return folder.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """The same rows read back from a table in the shared folder: computed once, safe when executors are lost."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression="zstd")
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _hadoop(spark: SparkSession, path: str):
    """Hadoop's view of a path, and the file system it is in."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def names_in(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, none if it does not exist."""
    at, files = _hadoop(spark, folder)
    return [status.getPath().getName() for status in files.listStatus(at)] if files.exists(at) else []


def text_of(spark: SparkSession, path: str) -> str | None:
    """The text of a small file; None if it is no file that can be read."""
    at, files = _hadoop(spark, path)
    if not files.exists(at) or not files.getFileStatus(at).isFile():
        return None
    stream = files.open(at)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def create_once(spark: SparkSession, path: str, text: str) -> bool:
    """Makes a small file with this text, unless there is something of its name: then False, and nothing changes.

    Of any number of writers at the same time one succeeds, and no reader sees a part of the text: it is written under
    a name of its own and then gets its name in one step that never replaces. On local disks this is a hard link,
    elsewhere a rename without overwriting, which the file system must do in one step, as HDFS does.
    """
    at, files = _hadoop(spark, path)
    files.mkdirs(at.getParent())
    temporary = f"{path.rsplit('/', 1)[0]}/_new-{uuid.uuid4().hex}"
    new, _ = _hadoop(spark, temporary)
    stream = files.create(new, False)
    stream.write(bytearray(text.encode()))
    stream.close()
    try:
        if files.getScheme() == "file":
            os.link(new.toUri().getPath(), at.toUri().getPath())
        else:
            rename = getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename")
            never = spark.sparkContext._gateway.new_array(rename, 1)
            never[0] = rename.NONE
            context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), spark._jsc.hadoopConfiguration())
            context.rename(new, at, never)
    except FileExistsError:
        return False
    except Py4JJavaError as error:
        if not error.java_exception.getClass().getSimpleName() == "FileAlreadyExistsException":
            raise
        return False
    finally:
        if files.exists(new):
            files.delete(new, False)
    return True

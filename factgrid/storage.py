"""Tables written once and read again, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Spark drops the shuffle files of a query at its end, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Folders of the calls that are running, the innermost last.
_calls: ContextVar[tuple[str, ...]] = ContextVar("calls", default=())


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it in ``spark.checkpoint.dir``.

    Where it is unset a local session gets a temporary folder; on a cluster
    that is an error, since no executor would see it.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="factgrid-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def stash(df: DataFrame, outer: bool = False) -> DataFrame:
    """Write ``df`` once to the shared folder and return it re-read.

    This cuts lineage: later steps read files that every executor sees, so a
    lost executor costs a re-read and never a recomputation of the chain, and
    what was moved to make the table goes from the disks as soon as it is there.
    Inside ``call`` the files go to the call's folder, with ``outer`` to that
    of the call around it.
    """
    path = folder(df.sparkSession, outer)
    put(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def put(df: DataFrame, path: str) -> None:
    """Write ``df`` to a new folder, and drop what was moved for it."""
    conf = df.sparkSession.conf
    was = conf.get(CLEANUP, "false")
    conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(CLEANUP, was)


def folder(spark: SparkSession, outer: bool = False) -> str:
    """A new folder's path where ``stash`` writes."""
    folders = _calls.get()[:-1] if outer else _calls.get()
    return f"{folders[-1] if folders else shared_dir(spark) + '/stash'}/{uuid.uuid4().hex}"


@contextmanager
def call(spark: SparkSession) -> Iterator[None]:
    """Tables stashed inside are removed at the end; a result must be written before, as by ``stash(df, outer=True)``."""
    path = f"{shared_dir(spark)}/stash/{uuid.uuid4().hex}"
    token = _calls.set((*_calls.get(), path))
    try:
        yield
    finally:
        _calls.reset(token)
        remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder, wherever the session's file systems have it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def commit(spark: SparkSession, folder: str, name: str, content: str) -> bool:
    """Put a whole file into ``folder`` under ``name``, unless that name is taken; whether it was free.

    The file is written beside it and renamed without overwriting, which file
    systems like HDFS do in one step: a file that is there is complete, and of
    several writers of one name a single one succeeds.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs
    at, waiting = hadoop.Path(f"{folder}/{name}"), hadoop.Path(f"{folder}/.{name}-{uuid.uuid4().hex}")
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(at):
        return False
    out = fs.create(waiting, False)
    out.write(bytearray(content.encode()))
    out.close()
    try:
        files = hadoop.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
        files.rename(fs.makeQualified(waiting), fs.makeQualified(at), spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 0))
    except Exception as e:
        fs.delete(waiting, False)
        if "AlreadyExists" in str(e):
            return False
        raise
    return True


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names of the complete files of a folder, in order; none if it is not there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(n for s in fs.listStatus(at) if (n := s.getPath().getName())[0] != ".") if fs.exists(at) else []


def content(spark: SparkSession, file: str) -> str:
    """The text of a small file."""
    at = spark._jvm.org.apache.hadoop.fs.Path(file)
    stream = at.getFileSystem(spark._jsc.hadoopConfiguration()).open(at)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def forget(df: DataFrame) -> None:
    """Delete the files of a stashed table that nothing reads any more."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/stash/" in folder:
            remove(df.sparkSession, folder)


def clear(spark: SparkSession) -> None:
    """Remove all written intermediate tables, when no result that reads them is wanted any more."""
    remove(spark, f"{shared_dir(spark)}/stash")

"""Where intermediate results are kept."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster shares, as its session names it in spark.checkpoint.dir. Only a session that runs in this process
    alone gets a folder of its own where none is named; on a cluster that is an error, as no machine sees another's folders."""
    found = spark.sparkContext._jsc.sc().getCheckpointDir()
    if found.isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not one_machine(spark):
            raise ValueError("the session names no shared folder in spark.checkpoint.dir")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="lumetext-"))
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
    return found.get()


def one_machine(spark: SparkSession) -> bool:
    """Whether driver and executors are one process."""
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def cut(df: DataFrame) -> DataFrame:
    """``df`` stored in the shared folder: its lineage ends there, and a lost executor costs nothing that was computed before."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def drop_cut(df: DataFrame) -> None:
    """Removes the files of a table of ``cut`` that nothing will read any more."""
    file = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
    if file.isDefined():
        remove(df.sparkSession, file.get())


def stored(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` as a table in the shared folder, and its path: as cut, but later reads take only the columns they need, and ``remove``
    gives the space back as soon as the table has served."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def _at(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def remove(spark: SparkSession, path: str) -> None:
    fs, at = _at(spark, path)
    fs.delete(at, True)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path of any file system that the session knows is there."""
    fs, at = _at(spark, path)
    return fs.exists(at)


def is_folder(spark: SparkSession, path: str) -> bool:
    fs, at = _at(spark, path)
    return fs.exists(at) and fs.getFileStatus(at).isDirectory()


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies right inside a folder."""
    fs, at = _at(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(at))


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text, None if there is no such file."""
    fs, at = _at(spark, path)
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        return bytes(stream.readAllBytes()).decode("utf-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Puts a small file in place as a whole: readers see the old text or the new one."""
    fs, at = _at(spark, path)
    _, new = _at(spark, f"{path}.{uuid4().hex}")
    stream = fs.create(new, True)
    try:
        stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()
    fs.delete(at, False)
    fs.rename(new, at)


def replace_folder(spark: SparkSession, new: str, old: str, names: tuple[str, ...]) -> None:
    """Moves folders from ``new`` into ``old``; what was there is kept beside them until all are in place, so nothing is lost if this
    ends half-way."""
    fs, _ = _at(spark, old)
    path = lambda p: spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
    moved = [n for n in names if exists(spark, f"{new}/{n}")]
    for n in moved:
        remove(spark, f"{old}/{n}.before")
        if exists(spark, f"{old}/{n}"):
            fs.rename(path(f"{old}/{n}"), path(f"{old}/{n}.before"))
        fs.rename(path(f"{new}/{n}"), path(f"{old}/{n}"))
    for n in moved:
        remove(spark, f"{old}/{n}.before")
    remove(spark, new)


def spread(df: DataFrame) -> DataFrame:
    """``df``, a scan before costly work, over all cores if its files give fewer tasks than there are cores. What then moves is bounded
    by a scan's partition for each core; an input with a partition for each core never moves."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df

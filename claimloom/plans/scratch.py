"""Tables written once in the shared folder, to cut lineage and to hold iterations' states."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """This application's folder in that of spark.checkpoint.dir.

    Where that is unset, a local[...] master gets a temporary folder, and any other master an
    error: executors on other machines could not read what is written there. The folder is
    deleted when the application ends.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="claimloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    folder = f"{root}/claimloom/{spark.sparkContext.applicationId}"
    if folder not in _made:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        _made.add(folder)
    return folder


_made: set[str] = set()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new place in the shared folder."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def write_table(df: DataFrame, label: str, compression: str | None = None) -> tuple[DataFrame, str]:
    """Write df as Parquet in the shared folder and read it back: the table and its place, for drop_table."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


_STATIC, _MEASURED = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
#: Files of a job's shuffles are deleted when it ends, not when the driver happens to collect its garbage.
_CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Of tables that are read a few times: a third less disk than by the default.
COMPRESSION = "zstd"


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """The session with these settings; afterwards as it was."""
    before = {key: spark.conf.get(key, None) for key in values}
    for key, value in values.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


@contextmanager
def measured_broadcasts(spark: SparkSession) -> Iterator[None]:
    """Jobs started within it broadcast a side of a join (without a hint) by what its shuffle has measured, not by the size of its files.

    Ids and repeated names take a hundredth of their memory in Parquet files, so a side that looks
    small there can be more than a driver holds. The session's limit stays the same, and so does the
    session afterwards.
    """
    with _settings(spark, {_MEASURED: spark.conf.get(_MEASURED, None) or spark.conf.get(_STATIC), _STATIC: "-1"}):
        yield


@contextmanager
def lean_jobs(spark: SparkSession) -> Iterator[None]:
    """measured_broadcasts, and each job's shuffle files go with its end. For jobs whose result is written or collected once."""
    with measured_broadcasts(spark), _settings(spark, {_CLEANED: "true"}):
        yield


#: Materialized tables of the innermost passing_tables, with their places.
_written: ContextVar[dict[int, tuple[DataFrame, str]] | None] = ContextVar("written", default=None)


@contextmanager
def passing_tables(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """What is materialized within it is deleted at its end, but for the tables that the function it gives was called with. Nothing else that was made within may be read afterwards; scratch_path's places stay."""
    outer, mine = _written.get(), {}
    token = _written.set(mine)

    def keep(df: DataFrame) -> DataFrame:
        path = mine.pop(id(df))[1]
        if outer is not None:
            outer[id(df)] = df, path
        return df

    try:
        yield keep
    finally:
        _written.reset(token)
        for _, path in mine.values():
            drop_table(spark, path)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back; lost executors then cost no recomputation."""
    with lean_jobs(df.sparkSession):
        out, path = write_table(df, label, COMPRESSION)
    if (mine := _written.get()) is not None:
        mine[id(out)] = out, path
    return out


def drop_table(spark: SparkSession, path: str) -> None:
    """Delete a scratch table that no result reads any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def release(spark: SparkSession) -> None:
    """Delete this application's scratch tables now. Call it when no result that reads them is needed any more."""
    folder = shared_folder(spark)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    _made.discard(folder)

"""Intermediate tables in the folder all executors share."""

import contextlib
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Open scopes of the running thread, innermost last; a new thread starts without any.
_open_scopes: ContextVar[tuple[list[str], ...]] = ContextVar("open_scopes", default=())


@functools.lru_cache(maxsize=1)
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="eventsift-")


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only on a local master."""
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        conf = _local_folder()
    return f"{conf.rstrip('/')}/eventsift-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, label: str) -> str:
    """An unused path in the shared folder, listed for removal by the innermost ``scratch`` of this thread."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    if scopes := _open_scopes.get():
        scopes[-1].append(path)
    return path


def materialise(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` once as Parquet and read it back.

    Later passes then prune columns and skip the work behind ``df``, a lost executor costs
    a re-read instead of a re-run, and values that depend on task layout stay fixed. Inside ``scratch`` the
    table is listed for removal.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def scratch() -> Iterator[list[str]]:
    """Collect the paths that this thread writes by ``materialise`` inside the block; ``discard`` removes them."""
    paths: list[str] = []
    before = _open_scopes.set((*_open_scopes.get(), paths))
    try:
        yield paths
    finally:
        _open_scopes.reset(before)


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Remove tables nothing reads any more, on whatever file system they are."""
    for path in paths:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    paths.clear()


def settled(spark: SparkSession, build: Callable[[], DataFrame], label: str = "result") -> DataFrame:
    """What ``build`` returns, stored once; the tables it stored on its way are removed, also if it fails."""
    with scratch() as paths:
        try:
            built = build()
        except BaseException:
            discard(spark, paths)
            raise
    try:
        return materialise(built, label)
    finally:
        discard(spark, paths)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores when it reads few files, as with one small file.

    Decided by the number of input files alone; tables of cluster size have more files than cores and are left as
    they are, and so are plans without files.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    files = len(df.inputFiles())
    return df.repartition(cores) if 0 < files * 2 <= cores else df

"""Work tables of long jobs, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []


def work_folder(spark: SparkSession) -> str:
    """This application's folder for work tables: under spark.checkpoint.dir, else under the context's checkpoint folder.

    Only where neither is set and all tasks run on this machine (tests, a laptop) a
    folder of our own becomes the checkpoint folder; on a cluster executors couldn't
    see it, so one must be named there.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not sc._jsc.sc().getCheckpointDir().isDefined():  # noqa: SLF001
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="corploom-"))
        root = sc._jsc.sc().getCheckpointDir().get()  # noqa: SLF001
    return f"{root.rstrip('/')}/corploom-{sc.applicationId}"


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder that no one else writes; what is put there goes when the driver ends."""
    path = f"{work_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


#: Spark deletes the shuffle files of a finished job, instead of when the driver's garbage happens to be collected.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def materialize(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write df as a work table and return a scan of it; options are the writer's.  The table goes with release(), at the latest when the driver ends.

    What depends on how a plan ran - generated ids, partition numbers, sampled
    ranges - is fixed from here on, and a lost executor costs a re-read.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    with _setting(spark, _CLEANUP, "true"):  # the plan that writes the table runs once
        df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._work_path = path  # noqa: SLF001
    return out


@contextmanager
def scratch() -> Iterator[Callable[..., None]]:
    """Work tables that are written within go at the end, but for those that the yielded function is given: what a lazy result still reads."""
    before, kept = {path for _, path in _made}, set()
    try:
        yield lambda *tables: kept.update(getattr(df, "_work_path", None) for df in tables)
    finally:
        for spark, path in [m for m in _made if m[1] not in before and m[1] not in kept]:
            release_folder(spark, path)


def release(*tables: DataFrame) -> None:
    """Delete work tables that nothing will read any more."""
    for df in tables:
        path = getattr(df, "_work_path", None)
        if path:
            _delete(df.sparkSession, path)
            _made[:] = [m for m in _made if m[1] != path]


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)  # noqa: SLF001


def release_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder that new_folder named, where the application that made it is the one that runs."""
    if (spark, path) in _made:
        _delete(spark, path)
        _made.remove((spark, path))


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)  # noqa: SLF001


def _sweep() -> None:
    for spark, path in _made:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone, and the folder with it
            return


atexit.register(_sweep)

"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir`.

    Where none is named, a local session (as in tests) gets a temporary folder; on a
    cluster that would be a folder of one machine, so it is an error there.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="rhetree-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
        sc.setCheckpointDir(named)
    return named


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/rhetree-{what}-{uuid.uuid4().hex}"


#: Paths of the tables that the operator now being run (in this thread) has written.
_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


def written(df: DataFrame, what: str) -> DataFrame:
    """`df` as a table in the shared folder: cuts the lineage, survives lost executors."""
    path = new_path(df.sparkSession, what)
    if (made := _made.get()) is not None:
        made.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def large(df: DataFrame) -> DataFrame:
    """`df`, which a join is to sort, not to broadcast.

    For tables that grow with the corpus: of a written table (compressed) or an exploded
    one Spark takes far too small a size, and would send millions of rows to the driver.
    """
    return df.hint("merge")


def deleted(spark: SparkSession, paths: list[str]) -> None:
    """Deletes tables of the shared folder."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for name in paths:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(conf).delete(path, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are written within are deleted at its end, also on an error."""
    own: list[str] = []
    token = _made.set(own)
    try:
        yield
    finally:
        _made.reset(token)
        deleted(spark, own)


def concluded(make: Callable[[], DataFrame], what: str) -> DataFrame:
    """What `make` returns as a table; the tables that were written on the way to it are deleted.

    The table itself belongs to the operator around this one, if there is one, and else
    stays: the frame returned reads it.
    """
    spark = SparkSession.active()
    path = new_path(spark, what)
    if (made := _made.get()) is not None:
        made.append(path)
    with scratch(spark):
        out = make()
        out.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(out.schema).parquet(path)


def new_table(spark: SparkSession, what: str) -> str:
    """A path for a table that is written piece by piece; deleted like those of `written`."""
    path = new_path(spark, what)
    if (made := _made.get()) is not None:
        made.append(path)
    return path

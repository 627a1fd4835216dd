"""Cutting lineage with tables in the folder that driver and executors share.

An intermediate result that is used more than once, or that ends a round of an
iterative operator, is written as Parquet under ``spark.checkpoint.dir`` and read
again. Such files outlive any executor, carry exact sizes for the planner and
keep the lineage of a loop short.
"""

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
_OWN: dict[str, str] = {}
_SCOPES: list[list["Stored"]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only a session that runs in one process may leave that unset and gets a
    temporary folder; on a cluster a driver's folder is no place for tables.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="tidewire-")
    return _OWN[app]


def own_dir(spark: SparkSession) -> str:
    """This application's folder in the shared one."""
    return f"{shared_dir(spark)}/tidewire/{spark.sparkContext.applicationId}"


def _delete(spark: SparkSession, where: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def clear(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application; results that read them must be stored by then."""
    _delete(spark, own_dir(spark))


class Stored:
    """A table in the shared folder: ``df`` reads it, ``drop`` deletes it.

    ``rows``: how many rows an Arrow batch has at most while it is written, where those are large.
    """

    def __init__(self, df: DataFrame, name: str = "t", rows: int | None = None):
        self.spark = df.sparkSession
        self.path = f"{own_dir(self.spark)}/{name}-{uuid.uuid4().hex}"
        was = self.spark.conf.get(ARROW_ROWS, None)
        if rows:
            self.spark.conf.set(ARROW_ROWS, rows)
        try:
            df.write.parquet(self.path)
        finally:
            if rows:
                self.spark.conf.unset(ARROW_ROWS) if was is None else self.spark.conf.set(ARROW_ROWS, was)
        if _SCOPES:
            _SCOPES[-1].append(self)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        _delete(self.spark, self.path)


def cut(df: DataFrame, name: str = "t", rows: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and return a reader of it."""
    return Stored(df, name, rows).df


def settled(build: Callable[[], DataFrame], name: str = "t", rows: int | None = None) -> DataFrame:
    """Store what ``build`` returns, delete all other tables that it stored on the way, and return a reader."""
    _SCOPES.append([])
    try:
        result = Stored(build(), name, rows)
    finally:
        own = _SCOPES.pop()
    for table in own:
        if table is not result:
            table.drop()
    if _SCOPES:
        _SCOPES[-1].append(result)
    return result.df

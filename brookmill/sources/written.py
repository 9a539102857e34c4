"""Intermediate tables in the shared folder, and their removal."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame

from brookmill.session import shared_folder

_open = threading.local()


class Passing:
    """The tables written within a scope, and those of them that outlive it."""

    def __init__(self) -> None:
        self.made: list[DataFrame] = []
        self.kept: set[str] = set()

    def keep(self, *tables: DataFrame) -> None:
        """Leave these written tables to the scope around this one."""
        self.kept |= {t._written_path for t in tables}


@contextmanager
def passing() -> Iterator[Passing]:
    """Tables that written() makes within are removed at the end, but for those kept.

    What is returned from within must read kept tables only.
    """
    scopes = _open.__dict__.setdefault("scopes", [])
    scopes.append(Passing())
    try:
        yield scopes[-1]
    finally:
        scope = scopes.pop()
        for t in scope.made:
            if t._written_path not in scope.kept:
                discard(t)
            elif scopes:
                scopes[-1].made.append(t)


def written(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: it is computed once, and
    lost executors cost no more than a second read."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._written_path = path
    if scopes := _open.__dict__.get("scopes"):
        scopes[-1].made.append(back)
    return back


def discard(df: DataFrame) -> None:
    """Remove a table made by written() that nothing will read again."""
    spark, path = df.sparkSession, df._written_path
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)

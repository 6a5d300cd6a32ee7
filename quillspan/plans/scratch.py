"""Intermediate tables in the shared checkpoint folder.

A written table cuts lineage, survives lost executors, keeps columns prunable and gives the
planner true sizes for its choice of joins.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_open: ContextVar[list[Scratch] | None] = ContextVar("open scratch tables", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. Where it is unset, a local session gets a temporary one; a cluster must name its own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='quillspan-')}"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


@contextmanager
def scratch_scope() -> Iterator[None]:
    """Tables that operators write inside are deleted at its end: write or collect whatever reads them before."""
    mine: list[Scratch] = []
    token = _open.set(mine)
    try:
        yield
    finally:
        _open.reset(token)
        for s in mine:
            s.close()


class Scratch:
    """Tables of one run of an operator, by name. Rewriting a name leaves the older table alone."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.base = spark, f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        self._paths: list[str] = []
        scope = _open.get()
        if scope is not None:
            scope.append(self)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.base}/{len(self._paths) + 1:03d}-{name}"
        self._paths.append(path)
        df.write.parquet(path)
        out = self.spark.read.schema(_nullable(df.schema)).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that no result still reads."""
        for t in tables:
            self._delete(t._scratch_path)

    def keep(self, *tables: DataFrame) -> None:
        """Delete all tables but these, the only ones that results still read."""
        stay = {t._scratch_path for t in tables}
        for path in self._paths:
            if path not in stay:
                self._delete(path)

    def close(self) -> None:
        """Delete all tables."""
        self._delete(self.base)

    def _delete(self, path: str) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def _nullable(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema])

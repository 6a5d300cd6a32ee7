"""Session defaults, and readers of the tables that the queries use."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: AQE splits skewed joins and coalesces small partitions; UTC keeps results equal everywhere.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g", **more: str) -> SparkSession:
    """A session for tests and the bench; on a cluster, pass your own session to the operators."""
    b = SparkSession.builder.master(f"local[{cores}]").appName("quillspan")
    conf = DEFAULTS | {"spark.sql.shuffle.partitions": str(partitions), "spark.driver.memory": memory} | more
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of a data folder; any path that Spark's readers open will do."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: Scans of more splits than this are never dealt anew: at 128 MB a split, 8 GB is the most that spread() exchanges.
FEW_SPLITS = 64


def spread(df: DataFrame, most: int = FEW_SPLITS) -> DataFrame:
    """df in as many partitions as there are cores, if its scan has fewer and no more than most (a small table, or a file that can't be split); else df.

    For work on whole rows that costs more than moving them.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    splits = df.rdd.getNumPartitions()
    return df.repartition(cores) if splits < cores and splits <= most else df


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once an application, so that Python workers find it wherever they start."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    to = Path(tempfile.mkdtemp(prefix="quillspan-")) / f"{root.name}.zip"
    with zipfile.ZipFile(to, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(to))
    _shipped.add(app)

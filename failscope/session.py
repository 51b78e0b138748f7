"""Session helpers: time zone, and the shared folder for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the time zone that results depend on, and two settings for wide projections.

    A generated method over 8,000 bytes is never compiled by the JVM, so wide feature
    projections run faster split by operator. Lower-casing goes through the JDK, which
    has a fast path for ASCII.
    """
    ship(spark)
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    spark.conf.set("spark.sql.icu.caseMappings.enabled", "false")
    return spark


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application.

    Functions that run in workers are pickled by name, and a worker may start in any folder
    and on any machine. Where the package is installed on all of them this does no harm.
    """
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="package-")) / "failscope.zip"
    with zipfile.ZipFile(path, "w") as archive:
        for source in sorted(package.rglob("*.py")):
            archive.write(source, source.relative_to(package.parent))
    context.addPyFile(str(path))
    _SHIPPED.add(context.applicationId)


_LOCAL_FOLDER: dict[str, str] = {}


def work_folder(spark: SparkSession) -> str:
    """Shared folder for tables that cut lineage.

    The cluster names it in ``spark.checkpoint.dir``. A machine-local folder is
    used only where that is unset and the master is local.
    """
    conf = spark.sparkContext.getConf()
    folder = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/") + "/failscope-work"
    master = conf.get("spark.master", "")
    if not master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_FOLDER:
        _LOCAL_FOLDER[app] = tempfile.mkdtemp(prefix="failscope-work-")
    return _LOCAL_FOLDER[app]


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of an input with fewer splits than cores out to all cores.

    For work that is heavy per row. A large input has more splits than cores and is
    returned as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def new_path(spark: SparkSession, name: str) -> str:
    return f"{work_folder(spark)}/{name}-{uuid.uuid4().hex}"


def write_observed(df: DataFrame, path: str, **metrics: Column) -> dict:
    """Write parquet and return aggregates of the written rows from the same job."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows"), *[
        c.alias(n) for n, c in metrics.items()]).write.parquet(path)
    return seen.get


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Used where a loop would otherwise grow its lineage or where one result feeds
    several jobs. A lost executor costs a re-read, not a re-run, and the written
    table carries its real size, so later joins are planned from it.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Parts:
    """Tables of one loop: written one after another, read together in one scan."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.root = spark, new_path(spark, name)
        self.paths: list[str] = []

    def add(self, df: DataFrame, **metrics: Column) -> DataFrame:
        """Write the next table; its row count and ``metrics`` are in ``self.seen``."""
        path = f"{self.root}/{len(self.paths)}"
        self.schema = df.schema
        self.seen = write_observed(df, path, **metrics)
        self.paths.append(path)
        return self.spark.read.schema(self.schema).parquet(path)

    def drop_last(self) -> None:
        self.paths.pop()

    def part(self, at: int) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.paths[at])

    def all(self) -> DataFrame:
        if not self.paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*self.paths)

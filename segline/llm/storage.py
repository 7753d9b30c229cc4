"""Intermediate tables in the folder that all machines of the cluster share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from segline.session import on_workers

_OWN: dict[str, str] = {}

#: Rows of a few numbers that a join may broadcast (some 100 MB of the driver's memory); more of them are joined by a shuffle.
FEW = 1_000_000


def shared_root(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset and the master local (tests), a new temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir is not set: intermediate tables need a folder that all machines share")
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            _OWN[app] = "file://" + tempfile.mkdtemp(prefix="spark-segline-")
        root = _OWN[app]
    return root.rstrip("/")


def shuffled(df: DataFrame) -> DataFrame:
    """df as a side of a join that must not be broadcast. Spark takes a table for as small as its compressed files and an
    explode for one row a row, so its own choice may bring many times its limit to the driver."""
    return df.hint("shuffle_merge")


def unless_few(df: DataFrame, rows: int, few: int = FEW) -> DataFrame:
    """df as a side of a join: with more than so many counted rows it is not broadcast."""
    return df if rows <= few else shuffled(df)


class Workspace:
    """Written tables cut lineage: a lost executor costs its own tasks, never an earlier stage.

    Every table is Parquet in a folder of its own, so two runs never meet. drop() frees a table that
    no later plan reads; the tables behind a returned DataFrame stay, since it is lazy.
    """

    def __init__(self, spark: SparkSession, name: str):
        on_workers(spark)
        self.spark = spark
        self.path = f"{shared_root(spark)}/segline-{name}-{uuid.uuid4().hex}"
        self._n = 0

    def save(self, df: DataFrame, name: str) -> DataFrame:
        return self.measured(df, name)[0]

    def measured(self, df: DataFrame, name: str, **marks: Column) -> tuple[DataFrame, dict]:
        """The written table and, of its rows, their number n and other aggregates, taken while it is written."""
        self._n += 1
        path = f"{self.path}/{self._n:03d}-{name}"
        seen = Observation()
        df.observe(seen, F.count(F.lit(1)).alias("n"), *(c.alias(k) for k, c in marks.items())).write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._segline_path = path
        return out, seen.get

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
            path = jvm.org.apache.hadoop.fs.Path(table._segline_path)
            path.getFileSystem(conf).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

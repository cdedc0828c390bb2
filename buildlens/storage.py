"""Intermediate tables in the folder that a cluster shares."""

from __future__ import annotations

import atexit
import re
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, or else the context's checkpoint folder; on one machine, one of our own. On a
    cluster without either it is an error: executors wouldn't share it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    chosen = spark.sparkContext._jsc.sc().getCheckpointDir()
    if named or chosen.isDefined():
        return named or chosen.get()
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return "file:///tmp/checkpoints"


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


class Written:
    """A table written once to the shared folder: cuts the lineage and survives lost executors."""

    def __init__(self, df: DataFrame, name: str):
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark).rstrip('/')}/buildlens/{self.spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)
        atexit.register(self.drop)

    def drop(self) -> None:
        """Removes the table as soon as no later plan reads it; else it goes when the application ends."""
        try:
            delete(self.spark, self.path)
        except Exception:  # noqa: BLE001  the session is gone: nothing left to do
            return
        atexit.unregister(self.drop)


class Growing:
    """A table that grows by parts, each written once and never again."""

    def __init__(self, first: DataFrame, name: str):
        self.spark, self.schema = first.sparkSession, first.schema
        self.name, self.parts = name, [Written(first, name)]

    @property
    def df(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*[p.path for p in self.parts])

    @property
    def last(self) -> DataFrame:
        return self.parts[-1].df

    def add(self, part: DataFrame) -> bool:
        """Writes a further part; whether it has a row."""
        self.parts.append(Written(part.select(*self.schema.names), self.name))
        return bool(self.last.head(1))

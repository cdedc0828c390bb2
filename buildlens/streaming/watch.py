"""A stream of source versions: which files changed, as they arrive.

The stateless front end of the incremental operators, and a stateful one that keeps the last hash of every file.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from buildlens.operators.incremental import upsert


def source_stream(spark: SparkSession, folder: str, schema: str = "path string, content string, at timestamp") -> DataFrame:
    """Versions of sources as Parquet files arrive in a folder."""
    return spark.readStream.schema(schema).parquet(folder)


def changed_files(stream: DataFrame) -> DataFrame:
    """(path, content_hash, change): a row whenever a file's content differs from the one seen before ("new" first).

    State is one hash for each file. Within a micro-batch a file's versions count in the order of `at`.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(parts)).sort_values("at", kind="stable")
        out = []
        for h in rows["content_hash"]:
            if h != last:
                out.append((key[0], h, "new" if last is None else "changed"))
                last = h
        if last is not None:
            state.update((last,))
        yield pd.DataFrame(out, columns=["path", "content_hash", "change"])

    hashed = stream.where("path is not null and content is not null").select("path", F.md5("content").alias("content_hash"), "at")
    return hashed.groupBy("path").applyInPandasWithState(step, "path string, content_hash string, change string", "content_hash string", "append", GroupStateTimeout.NoTimeout)


def change_counts(stream: DataFrame, window: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """Versions that arrived by window, with a watermark for late ones."""
    return stream.withWatermark("at", late).groupBy(F.window("at", window)).agg(F.count(F.lit(1)).alias("versions"), F.approx_count_distinct("path").alias("files"))


def upsert_batches(stream: DataFrame, cache_path: str, checkpoint: str):
    """Keeps a cache of artifacts (Parquet, one folder for each batch) up to date: a batch's rows replace those of their
    key. A batch that runs again writes the same folder."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        old = f"{cache_path}/{number - 1}"
        merged = batch if number == 0 else upsert(spark.read.parquet(old), batch)
        merged.write.mode("overwrite").parquet(f"{cache_path}/{number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)

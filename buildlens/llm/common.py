"""Shared helpers: intermediate tables in the cluster's shared folder, Arrow batches, word hashes.

All operators treat texts whole: a text of any length that fits in a row is read from its first to its last character,
one text at a time. Operators name the columns they read and rename them at once, so other columns may have any name.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import re
import uuid
from collections.abc import Callable, Iterator
from typing import ClassVar

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but the six ASCII white-space characters. bytes.split() uses the same six.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, or else the context's checkpoint folder. Without either, a local session
    (tests, one machine) gets one of our own; on a cluster that is an error, as executors wouldn't share it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    chosen = spark.sparkContext._jsc.sc().getCheckpointDir()
    if chosen.isDefined():
        return chosen.get()
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return "file:///tmp/checkpoints"


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


class staging:
    """with staging() as tables: ... - drops what is staged within at the end, but for what tables.keep was given,
    which an outer staging() holds then. Callers who have read a result give its tables back this way."""

    open: ClassVar[list[staging]] = []

    def __enter__(self) -> staging:
        self.held: list[Staged] = []
        self.open.append(self)
        return self

    def keep(self, table: Staged) -> Staged:
        self.held.remove(table)
        if len(self.open) > 1:
            self.open[-2].held.append(table)
        return table

    def __exit__(self, *_) -> None:
        self.open.remove(self)
        for table in self.held:
            table.drop()


class Staged:
    """A table written once to the shared folder: cuts the lineage and survives lost executors.

    drop() removes it as soon as no later plan reads it; what a returned DataFrame still reads goes with the caller's
    staging(), or else when the application ends. by: a column that its folders are named by, so that one value's rows
    are read alone.
    """

    def __init__(self, df: DataFrame, name: str, by: str | None = None):
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark).rstrip('/')}/buildlens/{self.spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
        out = df.write.option("parquet.block.size", str(32 << 20))  # small row groups: less memory in writers
        with small_batches(self.spark):
            (out.partitionBy(by) if by else out).parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)
        atexit.register(self.drop)
        if staging.open:
            staging.open[-1].held.append(self)

    def drop(self) -> None:
        try:
            _delete(self.spark, self.path)
        except Exception:  # noqa: BLE001  the session is gone: nothing left to do
            return
        atexit.unregister(self.drop)


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 1024) -> Iterator[None]:
    """Within it the session hands Arrow batches of few rows to workers, unless it was told a size; after it, as before."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, None) is not None:
        yield
        return
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.unset(key)


def raw(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column, without decoding."""
    return column.cast(pa.binary()).to_pylist()


class WordHash(dict):
    """64-bit hash of a word, remembered for up to `most` words."""

    def __init__(self, most: int = 150_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < self.most:
            self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64): spreads every input bit over the word."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def odd_constants(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of n words (multilinear, then mixed); empty when there are fewer words."""
    m = len(words) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    c = odd_constants(n, 77)
    out = words[:m] * c[0]
    for i in range(1, n):
        out = out + words[i : i + m] * c[i]
    return mix(out)


def lists(values: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    """An Arrow list column from one numpy array for each row."""
    offsets = np.zeros(len(values) + 1, np.int32)
    np.cumsum([len(v) for v in values], out=offsets[1:])
    flat = np.concatenate(values) if values else np.empty(0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, kind))


def word_count(text) -> F.Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


#: What an operator keeps in a Python worker from task to task, by its name.
KEPT: dict[str, dict] = {}


def _give_back() -> None:
    """Idle workers stay beside the JVM for long: freed memory goes back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def _drop_others(keeps: str) -> None:
    others = [name for name in KEPT if name != keeps]
    for name in others:
        del KEPT[name]
    if others:
        _give_back()


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], keeps: str = "") -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, before which the worker drops what other operators have kept in it, and after which it gives memory back."""

    def outer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _drop_others(keeps)  # by name: a nested function would take its own copy of KEPT to the worker
        yield from run(batches)
        _give_back()

    return outer


def batches_of(frames: Iterator[pa.RecordBatch], rows: int = 512, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in parts of at most `rows` rows and some `size` bytes (or one row), so that long texts don't gather
    in one. Cut here, in the worker: the session's own batch size stays as it is."""
    for b in frames:
        step = max(1, min(rows, size * b.num_rows // max(1, b.nbytes)))
        for i in range(0, b.num_rows, step):
            yield b.slice(i, step)

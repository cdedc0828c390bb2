"""Scans of source trees, compiler outputs and caches."""

from __future__ import annotations

import fnmatch
import os
import re
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from buildlens.functions.paths import file_name, join_path, parent
from buildlens.functions.solidity import normal_newlines
from buildlens.functions.versions import parse_version
from buildlens.sources.json_parts import read_parts
from buildlens.storage import Written

SOLIDITY = ("sol", "yul")
CACHE_SCHEMA = "_format string, files map<string, struct<lastModificationDate: long, contentHash: string, interfaceReprHash: string, sourceName: string, imports: array<string>, versionRequirement: string, artifacts: map<string, map<string, map<string, struct<path: string, build_id: string>>>>, seenByCompiler: boolean>>, builds array<string>"


def _relative(path: Column, root: str) -> Column:
    return F.regexp_replace(F.regexp_replace(path, "^file:/+", "/"), r"^\Q" + root.removeprefix("file://").rstrip("/") + r"\E/", "")


def _local_root(spark: SparkSession, root: str) -> str | None:
    """The local folder that root names, or null if it is something else or in another store."""
    p = spark._jvm.org.apache.hadoop.fs.Path(root)
    uri = p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(p).toUri()
    return uri.getPath() if uri.getScheme() == "file" and os.path.isdir(uri.getPath()) else None


def _entries(folder: str) -> Iterator[os.DirEntry]:
    """What a folder has, without the names that Spark takes for hidden."""
    with os.scandir(folder) as found:
        yield from (e for e in found if not e.name.startswith(".") and not e.name.endswith("._COPYING_") and ("=" in e.name or not e.name.startswith("_")))


def _branches(root: str, wanted: int, most: int = 10_000) -> list[tuple[str, bool]]:
    """Folders below root that are to be listed, alone or with all below them: `wanted` at least, if there are so many,
    and never many more than `most`."""
    alone, deep, waiting = [], [], [""]
    while waiting and len(alone) + len(deep) + len(waiting) < wanted:
        folder = waiting.pop(0)
        inner = list(islice((f"{folder}{e.name}/" for e in _entries(f"{root}/{folder}") if e.is_dir()), most + 1))
        (deep if len(inner) > most else alone).append(folder)
        waiting += inner if len(inner) <= most else []
    return [(f, False) for f in alone] + [(f, True) for f in deep + waiting]


def _listed(spark: SparkSession, root: str, extensions: tuple[str, ...]) -> DataFrame:
    """(path, length, modified) of the files below a local root, listed by the executors."""
    fits = re.compile("|".join(fnmatch.translate(f"*.{e}") for e in extensions) or r"(?!)").match

    def below(folder: str, deep: bool) -> Iterator[tuple[str, int, int]]:
        for e in _entries(f"{root}/{folder}"):
            if e.is_dir():
                if deep:
                    yield from below(f"{folder}{e.name}/", True)
            elif fits(e.name):
                try:
                    s = e.stat()
                except FileNotFoundError:  # a link that leads nowhere
                    continue
                yield f"{folder}{e.name}", s.st_size, s.st_mtime_ns // 1_000_000 * 1000

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string(), pa.int64(), pa.timestamp("us", "UTC")]
        for b in batches:
            files = (f for folder, deep in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for f in below(folder, deep))
            while some := list(islice(files, 10_000)):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), types, strict=True)], ["path", "length", "modified"])

    branches = _branches(root, 4 * spark.sparkContext.defaultParallelism)
    return spark.createDataFrame(branches, "folder string, deep boolean").mapInArrow(run, "path string, length long, modified timestamp")


def _contents(files: DataFrame, root: str) -> DataFrame:
    """(path, content) of files (path) below a local root."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, texts, held = [], [], 0
            for path in b.column(0).to_pylist():
                with open(f"{root}/{path}", "rb") as f:
                    texts.append(f.read())
                names.append(path)
                held += len(texts[-1])
                if held > 1 << 22:
                    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(texts, pa.binary())], ["path", "content"])
                    names, texts, held = [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(texts, pa.binary())], ["path", "content"])

    read = files.select("path").repartition(4 * files.sparkSession.sparkContext.defaultParallelism)
    return read.mapInArrow(run, "path string, content binary").select("path", F.col("content").cast("string").alias("content"))


def source_files(spark: SparkSession, root: str, extensions: tuple[str, ...] = SOLIDITY) -> DataFrame:
    """(path, content) of all files below root with one of the extensions; paths are relative to it.

    Local folders (and shared ones that are mounted) are listed and read by the executors; of other stores, Spark's
    reader keeps the listing in the driver.
    """
    if local := _local_root(spark, root):
        df = _contents(_listed(spark, local, extensions), local)
        return df.select("path", normal_newlines(F.col("content")).alias("content"))
    df = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.{" + ",".join(extensions) + "}").text(root, wholetext=True)
    return df.select(_relative(F.col("_metadata.file_path"), root).alias("path"), normal_newlines(F.col("value")).alias("content"))


def source_listing(spark: SparkSession, root: str, extensions: tuple[str, ...] = SOLIDITY) -> DataFrame:
    """(path, length, modified) without reading contents; where, see source_files."""
    if local := _local_root(spark, root):
        return _listed(spark, local, extensions)
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{" + ",".join(extensions) + "}").load(root)
    return df.select(_relative(F.col("path"), root).alias("path"), "length", F.col("modificationTime").alias("modified"))


def source_dirs(files: DataFrame) -> DataFrame:
    """The distinct directories that hold a file."""
    return files.select(parent(F.col("path")).alias("path")).distinct()


def project_inputs(spark: SparkSession, dirs: dict[str, str], extensions: tuple[str, ...] = SOLIDITY) -> DataFrame:
    """(path, content, kind) of several directories by kind (source, test, script); a path counts once, by its first
    kind in order. Missing directories are left out."""
    out = None
    for rank, (kind, root) in enumerate(dirs.items()):
        fs_path = spark._jvm.org.apache.hadoop.fs.Path(root)
        if not fs_path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(fs_path):
            continue
        part = source_files(spark, root, extensions).select(F.concat(F.lit(root.rstrip("/") + "/"), "path").alias("path"), "content", F.lit(kind).alias("kind"), F.lit(rank).alias("rank"))
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], "path string, content string, kind string")
    return out.groupBy("path").agg(F.min_by(F.struct("content", "kind"), "rank").alias("b")).select("path", "b.*")


def installed_versions(names: DataFrame) -> DataFrame:
    """(v) of directory names (name) that are versions, in order."""
    return names.select(parse_version(F.col("name")).alias("v")).where("v is not null").distinct().orderBy("v")


def other_case(wanted: DataFrame, listing: DataFrame) -> DataFrame:
    """(path, found): a file in the same directory whose name differs in ASCII case alone."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    key = lambda c: F.concat_ws("/", parent(F.col(c)), F.translate(file_name(F.col(c)), upper, lower))
    a, b = wanted.select("path", key("path").alias("k")), listing.select(F.col("path").alias("found"), key("path").alias("k"))
    return a.join(b, "k").where("path <> found").groupBy("path").agg(F.min("found").alias("found"))


def read_errors(wanted: DataFrame, listing: DataFrame) -> DataFrame:
    """(path, error) of files to read: null, the name in another case, or missing."""
    there = listing.select("path", F.lit(True).alias("there")).distinct()
    rows = wanted.select("path").distinct().join(there, "path", "left").join(other_case(wanted, listing), "path", "left")
    return rows.select("path", F.when(F.col("there"), F.lit(None).cast("string")).when(F.col("found").isNotNull(), F.concat(F.lit("wrong case: "), "found")).otherwise("missing").alias("error"))


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=True)


def _bytes(spark: SparkSession, path: str) -> int:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return sum(store.getContentSummary(s.getPath()).getLength() for s in store.globStatus(p) or [])


def _large_cache(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(path, f) of the files and (builds) of a cache that is read in pieces, none if a piece can't be read."""
    own, pieces = read_parts(spark, path, "files")
    kind = StructType.fromDDL(CACHE_SCHEMA)["files"].dataType
    parsed = Written(pieces.select(F.from_json("piece", kind).alias("files")), "cache").df
    rest = Written(own.select(F.from_json("own", CACHE_SCHEMA).alias("v")).select("v.*"), "cache").df
    if parsed.where("files is null").head(1):
        parsed, rest = parsed.limit(0), rest.limit(0)
    return parsed.unionByName(rest.select("files")).select(F.explode("files").alias("path", "f")), rest.select("builds")


def read_cache(spark: SparkSession, path: str, root: str = "", whole: int = 1 << 25) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entries, artifacts and builds of a cache file; with a root, paths are joined to it.

    A file of up to `whole` bytes is parsed in one row, a larger one in pieces by many tasks. One that isn't JSON has no rows.
    """
    at = lambda c: join_path(F.lit(root), c) if root else c
    if _bytes(spark, path) > whole:
        files, raw = _large_cache(spark, path)
    else:
        raw = read_json(spark, path, CACHE_SCHEMA)
        files = raw.select(F.explode("files").alias("path", "f"))
    entries = files.select(at(F.col("path")).alias("path"), F.col("f.lastModificationDate").alias("mtime_ms"), F.col("f.contentHash").alias("content_hash"), F.col("f.interfaceReprHash").alias("interface_hash"), F.col("f.sourceName").alias("source_name"), F.col("f.imports").alias("imports"), F.col("f.versionRequirement").alias("version_text"), F.coalesce("f.seenByCompiler", F.lit(False)).alias("seen"))
    rows = files.select("path", F.explode("f.artifacts").alias("name", "v")).select("path", "name", F.explode("v").alias("version", "p")).select("path", "name", "version", F.explode("p").alias("profile", "a"))
    artifacts = rows.select(at(F.col("path")).alias("path"), "name", "version", "profile", at(F.col("a.path")).alias("artifact_path"), F.col("a.build_id").alias("build_id"))
    return entries, artifacts, raw.select(F.explode("builds").alias("build_id"))


def read_builds(listing: DataFrame, builds: DataFrame, schema: str) -> DataFrame:
    """(build_id, build, error) for each of builds (build_id): its build-info file, <build_id>.json of listing (path,
    content), parsed; the error is missing or unreadable, else null. Other files are not parsed."""
    found = listing.where(F.endswith("path", F.lit(".json"))).select(F.regexp_replace(file_name(F.col("path")), r"\.json$", "").alias("build_id"), "content")
    rows = builds.select("build_id").distinct().join(found, "build_id", "left").groupBy("build_id").agg(F.min("content").alias("content"))
    rows = rows.withColumn("readable", F.try_parse_json("content").isNotNull())
    error = F.when(F.col("content").isNull(), "missing").when(~F.col("readable"), "unreadable")
    return rows.select("build_id", F.when(F.col("readable"), F.from_json("content", schema)).alias("build"), error.alias("error"))


def read_artifacts(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """Artifacts of several JSON files with their artifact_path; a file that can't be read is an error."""
    df = spark.read.schema(schema).option("mode", "FAILFAST").json(paths, multiLine=True)
    return df.withColumn("artifact_path", F.col("_metadata.file_path"))


def read_one(artifacts: DataFrame, path: str, name: str) -> DataFrame:
    return artifacts.where((F.col("path") == path) & (F.col("name") == name)).orderBy("version", "profile").limit(1)

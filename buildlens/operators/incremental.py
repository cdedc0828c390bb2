"""The incremental cache as tables: what is dirty, what can stay, and the upsert after a run.

cache_entries: path, content_hash, interface_hash, seen; cache_artifacts: path, name, version, profile, artifact_path,
build_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from buildlens.operators.graph import closure, dirty_files

KEY = ["path", "name", "version", "profile"]


def hashed(sources: DataFrame) -> DataFrame:
    """sources with content_hash; null content has none."""
    return sources.withColumn("content_hash", F.md5("content"))


def existing_entries(entries: DataFrame, listing: DataFrame) -> DataFrame:
    """Entries whose file is still there."""
    return entries.join(listing.select("path").distinct(), "path", "left_semi")


def unused_builds(builds: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Builds (build_id) that no artifact refers to."""
    return builds.join(artifacts.select("build_id").distinct(), "build_id", "left_anti")


def with_known_builds(artifacts: DataFrame, builds: DataFrame) -> DataFrame:
    """Artifacts whose build information is there."""
    return artifacts.join(builds.select("build_id").distinct(), "build_id", "left_semi")


def dirty_reasons(sources: DataFrame, entries: DataFrame, use_interface: bool = False) -> DataFrame:
    """(path, reason) of sources (path, content_hash, interface_hash): no entry, no hash, changed, or null if clean."""
    old = entries.select("path", F.col("content_hash").alias("old_hash"), F.col("interface_hash").alias("old_interface"), F.lit(True).alias("known"))
    now, was = (F.coalesce("interface_hash", "content_hash"), F.col("old_interface")) if use_interface else (F.col("content_hash"), F.col("old_hash"))
    reason = F.when(F.col("known").isNull(), "missing entry").when(now.isNull() | was.isNull(), "missing hash").when(now != was, "hash differs")
    return sources.join(old, "path", "left").select("path", reason.alias("reason"))


def dirty_sources(sources: DataFrame, entries: DataFrame, edges: DataFrame) -> DataFrame:
    """(path) of changed files and all that import them."""
    return dirty_files(edges, dirty_reasons(sources, entries).where("reason is not null").select("path"))


def missing_artifacts(files: DataFrame, entries: DataFrame, artifacts: DataFrame, listing: DataFrame, extra_missing: bool = False) -> DataFrame:
    """(path, version, profile, reason) of files in scope: why their artifacts have to be made, null if they needn't.

    In turn: no entry; seen and known to have none (fine); none for the version and profile; an artifact's file gone;
    extra files missing (of any artifact: a flag for the whole scope).
    """
    known = entries.select("path", "seen", F.lit(True).alias("known"))
    there = listing.select(F.col("path").alias("artifact_path"), F.lit(True).alias("there")).distinct()
    own = artifacts.join(there, "artifact_path", "left").groupBy("path", "version", "profile").agg(F.bool_or(F.col("there").isNull()).alias("gone"))
    any_own = artifacts.select("path").distinct().withColumn("has_any", F.lit(True))
    rows = files.join(known, "path", "left").join(any_own, "path", "left").join(own, ["path", "version", "profile"], "left")
    reason = (
        F.when(F.col("known").isNull(), "missing entry")
        .when(F.col("seen") & F.col("has_any").isNull(), F.lit(None).cast("string"))
        .when(F.col("gone").isNull(), "missing version and profile")
        .when(F.col("gone"), "missing artifact file")
        .when(F.lit(extra_missing), "missing extra files")
    )
    return rows.select("path", "version", "profile", reason.alias("reason"))


def artifact_lacks_output(wanted, present) -> Column:
    """Whether a requested output isn't in the artifact. wanted, present: arrays of output names; generatedSources is
    never kept, so a request for it always counts."""
    return F.array_contains(wanted, "generatedSources") | (F.size(F.array_except(wanted, present)) > 0)


def job_kinds(files: DataFrame, missing: DataFrame, edges: DataFrame) -> DataFrame:
    """(path, kind) of files (path) to compile: Complete where artifacts are missing (path), Optimized what those
    import; the rest is left out."""
    complete = missing.select("path").distinct()
    reach = closure(edges, complete.select(F.col("path").alias("root")), include_self=False).select(F.col("node").alias("path")).distinct()
    rest = reach.join(complete, "path", "left_anti").withColumn("kind", F.lit("Optimized"))
    return complete.withColumn("kind", F.lit("Complete")).unionByName(rest).join(files.select("path").distinct(), "path", "left_semi")


def reusable_profiles(old: DataFrame, new: DataFrame, fields: list[str]) -> DataFrame:
    """(profile, keep) of cached profiles: whether the project's profile of that name has the same settings."""
    now = new.select("profile", F.struct(*fields).alias("now"))
    return old.select("profile", F.struct(*fields).alias("was")).join(now, "profile", "left").select("profile", F.coalesce(F.col("was").eqNullSafe(F.col("now")) & F.col("now").isNotNull(), F.lit(False)).alias("keep"))


def drop_profiles(artifacts: DataFrame, entries: DataFrame, judged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Artifacts of profiles that stay, and the entries that still have one (those that never had any stay)."""
    kept = artifacts.join(judged.where("keep").select("profile"), "profile", "left_semi")
    emptied = artifacts.select("path").distinct().join(kept.select("path").distinct(), "path", "left_anti")
    return kept, entries.join(emptied, "path", "left_anti")


def cache_entry_rows(sources: DataFrame, imports: DataFrame) -> DataFrame:
    """Entries of sources (path, content, mtime_ms, version_text) with their distinct imports (src, dst) in order."""
    own = imports.groupBy(F.col("src").alias("path")).agg(F.array_sort(F.collect_set("dst")).alias("imports"))
    none = F.array().cast("array<string>")
    return hashed(sources).join(own, "path", "left").select("path", "mtime_ms", "content_hash", "version_text", F.coalesce("imports", none).alias("imports"), F.lit(True).alias("seen"))


def mark_seen(entries: DataFrame, seen: DataFrame) -> DataFrame:
    flag = seen.select("path").distinct().withColumn("_seen", F.lit(True))
    return entries.join(flag, "path", "left").withColumn("seen", F.col("seen") | F.coalesce("_seen", F.lit(False))).drop("_seen")


def upsert(cached: DataFrame, written: DataFrame) -> DataFrame:
    """Cached artifacts and written ones; a written one replaces the cached one of its key."""
    return cached.join(written.select(*KEY).distinct(), KEY, "left_anti").unionByName(written)


def consume(cached: DataFrame, in_scope: DataFrame, dirty: DataFrame, written: DataFrame) -> DataFrame:
    """The cache after a run: artifacts of files and versions in scope (path, version) that aren't dirty (path) nor
    written anew, and the written ones."""
    kept = cached.join(in_scope.select("path", "version").distinct(), ["path", "version"], "left_semi").join(dirty.select("path").distinct(), "path", "left_anti")
    kept = kept.join(written.select("path", "name", "version").distinct(), ["path", "name", "version"], "left_anti")
    return kept.unionByName(written)


def existing_artifacts(wanted: DataFrame, artifacts: DataFrame) -> DataFrame:
    """wanted (path, name, version, profile) with the cached artifact_path, or null."""
    return wanted.join(artifacts.select(*KEY, "artifact_path"), KEY, "left")


def can_use_cache(read_ok: bool, same_paths: bool, same_preprocessing: bool, resolved) -> bool:
    """Whether the cache counts at all: read, of the same paths and preprocessing, and no import unresolved."""
    return read_ok and same_paths and same_preprocessing and not resolved.where("path is null").head(1)

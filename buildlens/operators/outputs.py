"""Compiler outputs and artifacts: aggregation, lookup, unnesting, naming and construction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from buildlens.functions.paths import output_file
from buildlens.operators.resolve import first_in_order
from buildlens.storage import Written


def explode_contracts(outputs: DataFrame) -> DataFrame:
    """(job columns, path, name, contract) from map<path, map<name, contract>> in a column contracts."""
    rest = [c for c in outputs.columns if c != "contracts"]
    files = outputs.select(*rest, F.explode("contracts").alias("path", "by_name"))
    return files.select(*rest, "path", F.explode("by_name").alias("name", "contract"))


def explode_artifacts(artifacts: DataFrame) -> DataFrame:
    """(path, name, version, profile, artifact) from one column artifacts of
    map<path, map<name, array<struct<version, profile, artifact>>>>."""
    files = artifacts.select(F.explode("artifacts").alias("path", "by_name")).select("path", F.explode("by_name").alias("name", "all"))
    return files.select("path", "name", F.explode("all").alias("a")).select("path", "name", "a.*")


def artifacts_for_version(rows: DataFrame, version: str) -> DataFrame:
    return rows.where(F.col("version") == version)


def combined(cached: DataFrame, compiled: DataFrame) -> DataFrame:
    """All artifacts, cached and compiled ones."""
    return cached.unionByName(compiled, allowMissingColumns=True)


def last_wins(parts: list[DataFrame], key: list[str]) -> DataFrame:
    """Union of parts in which a later part's row of a key replaces earlier ones."""
    every = parts[0].withColumn("_part", F.lit(0))
    for i, p in enumerate(parts[1:], 1):
        every = every.unionByName(p.withColumn("_part", F.lit(i)))
    return first_in_order(every, key, [-F.col("_part")]).drop("_part")


def aggregated(jobs: list[DataFrame], key: list[str], tag: list[str]) -> DataFrame:
    """Outputs of all jobs, for each key the list of what the jobs gave, in the order of their tags."""
    every = jobs[0]
    for j in jobs[1:]:
        every = every.unionByName(j)
    rest = [c for c in every.columns if c not in key and c not in tag]
    return every.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(*tag, *rest))).alias("versions"))


def contract_paths(parsed: DataFrame) -> DataFrame:
    """(name, paths): the files (path, contract_names) that define each contract, each named once, in order."""
    return parsed.select("path", F.explode("contract_names").alias("name")).groupBy("name").agg(F.array_sort(F.collect_set("path")).alias("paths"))


def unique_contract_path(parsed: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """(name, path, error): the one file that defines the contract, or why there is none."""
    found = contract_paths(parsed)
    rows = found if names is None else names.select("name").join(found, "name", "left")
    n = F.coalesce(F.size("paths"), F.lit(0))
    return rows.select("name", F.when(n == 1, F.get("paths", 0)).alias("path"), F.when(n == 0, "not found").when(n > 1, "ambiguous").alias("error"))


def by_version(contracts: DataFrame) -> DataFrame:
    """(version, contracts array<struct<path, name>>)."""
    return contracts.groupBy("version").agg(F.array_sort(F.collect_list(F.struct("path", "name"))).alias("contracts"))


def versions_by_file(files: DataFrame) -> DataFrame:
    """(path, versions): the distinct versions each file is compiled with."""
    return files.groupBy("path").agg(F.array_sort(F.collect_set("version")).alias("versions"))


def first_by_name(rows: DataFrame) -> DataFrame:
    """For each name its first row, by path, version and profile."""
    return first_in_order(rows, ["name"], ["path", "version", "profile"])


def first_by_file_and_name(rows: DataFrame) -> DataFrame:
    return first_in_order(rows, ["path", "name"], ["version", "profile"])


def find(rows: DataFrame, name: str, path: str | None = None, version: str | None = None, profile: str | None = None) -> DataFrame:
    """The first row of a name, and of the path, version and profile where they are given (at most one row)."""
    hit = rows.where(F.col("name") == name)
    for column, value in (("path", path), ("version", version), ("profile", profile)):
        hit = hit if value is None else hit.where(F.col(column) == value)
    return hit.orderBy("path", "version", "profile").limit(1)


def take(rows: DataFrame, name: str, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The row that find gives, and all others."""
    one = find(rows, name, path)
    return one, rows.join(one.select("path", "name", "version", "profile"), ["path", "name", "version", "profile"], "left_anti")


def fresh_first(fresh: DataFrame, cached: DataFrame, key: list[str]) -> DataFrame:
    """For each key the first fresh row, or else the first cached one."""
    every = fresh.withColumn("origin", F.lit("fresh")).unionByName(cached.withColumn("origin", F.lit("cached")), allowMissingColumns=True)
    return first_in_order(every, key, [F.col("origin") == "cached", *[c for c in ("path", "version", "profile") if c not in key]])


def take_source(sources: DataFrame, source_id: int) -> tuple[DataFrame, DataFrame]:
    """The sources with a compiler's id, and all others."""
    return sources.where(F.col("source_id") == source_id), sources.where(~F.col("source_id").eqNullSafe(source_id))


def build_sources(outputs: DataFrame, inputs: DataFrame) -> DataFrame:
    """(build_id, source_id_to_path) of output sources (build_id, source_id, path) that were in the input (path)."""
    rows = outputs.join(inputs.select("path").distinct(), "path", "left_semi")
    return rows.groupBy("build_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("source_id", "path")))).alias("source_id_to_path"))


def build_id(format_: Column, version: Column, input_json: Column) -> Column:
    """An id of a build from what went into it."""
    return F.md5(F.concat_ws("\x00", format_, version, input_json))


def unique_hash(*parts: Column) -> Column:
    """An id of several strings, 16 hex digits."""
    return F.lower(F.lpad(F.hex(F.xxhash64(F.concat(*parts))), 16, "0"))


def combined_pragmas(parsed: DataFrame, by: list[str]) -> DataFrame:
    """(by, pragma): the distinct comparators of all files, sorted as text, joined by a space."""
    parts = parsed.select(*by, F.explode(F.split("version_text", r"[ ,]+")).alias("part")).where("part <> ''")
    return parts.groupBy(*by).agg(F.concat_ws(" ", F.array_sort(F.collect_set("part"))).alias("pragma"))


def common_ancestor_all(paths: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The longest common prefix of all paths, by component, from the least and the greatest of them."""
    from buildlens.functions.paths import common_ancestor

    # compared by component: the separator sorts before everything else
    low, high = (f(F.replace("path", F.lit("/"), F.lit("\x01"))) for f in (F.min, F.max))
    rows = paths.groupBy(*(by or [])).agg(low.alias("low"), high.alias("high"))
    back = lambda c: F.replace(c, F.lit("\x01"), F.lit("/"))
    return rows.select(*(by or []), common_ancestor(back("low"), back("high")).alias("ancestor"))


def artifact_files(contracts: DataFrame, primary_profile: str = "default") -> DataFrame:
    """contracts (path, name, version, profile) with file: their artifact's path below the artifacts folder.

    The version is in the name if the contract has several, the profile if it has several and this isn't the primary
    one.
    """
    several = contracts.groupBy("path", "name").agg((F.min("version") < F.max("version")).alias("_versions"), (F.min("profile") < F.max("profile")).alias("_profiles"))
    rows = contracts.join(several, ["path", "name"])
    with_profile = F.col("_profiles") & (F.col("profile") != primary_profile)
    file = output_file(F.col("path"), F.col("name"), F.when(F.col("_versions"), F.col("version")), F.when(with_profile, F.col("profile")))
    return rows.withColumn("file", file).select(*contracts.columns, "file")


def _alternative(n: Column) -> Column:
    """The n-th name of a file: itself, then with 1, 2 ... of its source's innermost directories in front, and beyond those
    with a number at its first component."""
    depth = F.size("_folders")
    longer = F.concat_ws("/", F.array_join(F.slice("_folders", F.greatest(depth - n + 1, F.lit(1)), F.least(n, depth)), "/"), F.col("_file"))
    numbered = F.concat(F.regexp_extract("_file", "^([^/]*)", 1), F.lit("_"), (n - depth).cast("string"), F.regexp_extract("_file", "^[^/]*(.*)$", 1))
    return F.when(n == 0, F.col("_file")).when(n <= depth, longer).otherwise(numbered)


def conflict_free(artifacts: DataFrame, taken: DataFrame | None = None) -> DataFrame:
    """artifacts (path, file, ...) with `file` unique, ignoring case, and none of `taken` (file).

    In rounds, one for each directory of the deepest path: of the rows that ask for one name the one with the fewest
    directories, then the first path, gets it, if it isn't taken; the others ask for their next name (see _alternative).
    What is left is numbered, the rows of one name by the same order at once; a number that is taken is followed by one
    beyond those of all the others. Only rows that still collide take part in a round.
    """
    folders = F.filter(F.slice(F.split("path", "/"), 1, F.greatest(F.size(F.split("path", "/")) - 1, F.lit(0))), lambda p: p != "")
    rows = artifacts.withColumnRenamed("file", "_file").withColumns({"_folders": folders, "_n": F.lit(0), "_row": F.monotonically_increasing_id()})
    waiting, done, numbered = Written(rows, "waiting"), [], []
    order = [F.size("_folders"), "path", *[F.col(c) for c in artifacts.columns if c not in ("path", "file")], "_row"]
    gone = artifacts.sparkSession.createDataFrame([], "_key string") if taken is None else taken.select(F.lower("file").alias("_key"))

    def ask(df: DataFrame) -> DataFrame:
        """Rows with the name they ask for, and whether it is taken."""
        names = gone
        for d in done:
            names = names.unionByName(d.df.select("_key"))
        asking = df.withColumn("file", _alternative(F.col("_n"))).withColumn("_key", F.lower("file"))
        return asking.join(names.distinct().withColumn("_gone", F.lit(True)), "_key", "left").withColumn("_taken", F.coalesce("_gone", F.lit(False))).drop("_gone")

    while waiting.df.head(1):
        ranked = ask(waiting.df).withColumn("_rank", F.row_number().over(Window.partitionBy("_key").orderBy(*order)))
        ranked = Written(ranked, "asking")
        got = ~F.col("_taken") & (F.col("_rank") == 1)
        done.append(Written(ranked.df.where(got).select(*artifacts.columns, "_key"), "settled"))
        rest = ranked.df.where(~got).withColumn("_n", F.col("_n") + 1).select(*rows.columns)
        numbered.append(Written(rest.where(F.col("_n") > F.size("_folders")), "numbered"))
        waiting.drop()
        waiting = Written(rest.where(F.col("_n") <= F.size("_folders")), "waiting")
    rest = numbered[0].df if numbered else rows.limit(0)
    for more in numbered[1:]:
        rest = rest.unionByName(more.df)
    by = Window.partitionBy(F.lower("_file"))
    rest = Written(rest.withColumns({"_n": F.size("_folders") + F.row_number().over(by.orderBy(*order)), "_all": F.count(F.lit(1)).over(by)}), "waiting")
    while rest.df.head(1):
        asked = Written(ask(rest.df), "asking")
        done.append(Written(asked.df.where(~F.col("_taken")).select(*artifacts.columns, "_key"), "settled"))
        after = Written(asked.df.where("_taken").withColumn("_n", F.col("_n") + F.col("_all")).select(*rest.df.columns), "waiting")
        rest.drop()
        rest = after
    return artifacts.sparkSession.read.schema(artifacts.schema).parquet(*[d.path for d in done]) if done else artifacts


def artifact_paths(contracts: DataFrame, cached: DataFrame, primary_profile: str = "default") -> DataFrame:
    """contracts with file: the cached artifact_path of the same key, or else a new one that no cached artifact and no
    other contract has.

    Names carry a version or profile where the contract has several among contracts and cached ones together.
    """
    key = ["path", "name", "version", "profile"]
    old = contracts.join(cached.select(*key, F.col("artifact_path").alias("file")), key)
    known = cached.join(contracts.select("path", "name").distinct(), ["path", "name"], "left_semi").select(*key)
    named = artifact_files(contracts.select(*key).unionByName(known).distinct(), primary_profile)
    new = contracts.join(named, key).join(cached.select(*key), key, "left_anti")
    return old.unionByName(conflict_free(new.select(*old.columns), cached.select(F.col("artifact_path").alias("file"))))


def standalone_sources(sources: DataFrame, contracts: DataFrame) -> DataFrame:
    """Sources (path, version, has_ast) with a syntax tree of which no contract came."""
    return sources.where("has_ast").join(contracts.select("path", "version").distinct(), ["path", "version"], "left_anti")


def compact_artifact(contract: Column) -> Column:
    """The interface and both codes of a contract struct<abi, bytecode, deployed>."""
    return F.struct(contract["abi"].alias("abi"), contract["bytecode"].alias("bytecode"), contract["deployed"].alias("deployedBytecode"))


def selected_artifact(contract: Column, fields: list[str], wanted: Column) -> Column:
    """A contract struct with the outputs that aren't in `wanted` set to null."""
    return F.struct(*[F.when(F.array_contains(wanted, f), contract[f]).alias(f) for f in fields])


def hardhat_artifact(path: Column, name: Column, contract: Column) -> Column:
    empty = F.lit("[]")
    links = F.lit("{}")
    return F.struct(
        F.lit("hh-sol-artifact-1").alias("_format"), name.alias("contractName"), path.alias("sourceName"), F.coalesce(contract["abi"], empty).alias("abi"), F.coalesce(contract["bytecode"], F.lit("0x")).alias("bytecode"),
        F.coalesce(contract["deployed"], F.lit("0x")).alias("deployedBytecode"), F.coalesce(contract["links"], links).alias("linkReferences"), F.coalesce(contract["deployed_links"], links).alias("deployedLinkReferences"),
    )


def output_selection(abi: bool = True, metadata: bool = False, ir: bool = False, ir_optimized: bool = False, assembly: bool = False, ewasm: bool = False, gas: bool = False, source_map: bool = False) -> list[str]:
    """Names of outputs to ask a compiler for."""
    wanted = [(abi, "abi"), (True, "evm.bytecode"), (True, "evm.deployedBytecode"), (True, "evm.methodIdentifiers"), (metadata, "metadata"), (ir, "ir"), (ir_optimized, "irOptimized"), (assembly, "evm.assembly"), (ewasm, "ewasm"), (gas, "evm.gasEstimates"), (source_map, "evm.bytecode.sourceMap")]
    return [n for on, n in wanted if on]


def depth_order(paths: Column) -> Column:
    """Sort key of files: by depth, then path."""
    return F.struct(F.size(F.split(paths, "/")).alias("depth"), paths.alias("path"))




def find_by_info(rows: DataFrame, info: str) -> DataFrame:
    """The first row of "path:name" or "name" (see paths.parse_contract_info)."""
    parts = info.split(":")
    return find(rows, parts[-1], parts[-2] if len(parts) > 1 else None)


def take_by_info(rows: DataFrame, info: str) -> tuple[DataFrame, DataFrame]:
    parts = info.split(":")
    return take(rows, parts[-1], parts[-2] if len(parts) > 1 else None)


def all_or_error(results: DataFrame) -> DataFrame:
    """results without their error column; any error (not null) fails the query with the first one."""
    first = results.agg(F.min("error").alias("e"))
    failed = F.when(first.scalar().isNotNull(), F.raise_error(first.scalar()).cast("boolean")).otherwise(F.lit(True))
    return results.where(failed).drop("error")


def artifacts_with_sources(cached: DataFrame, compiled: DataFrame) -> DataFrame:
    """Cached and compiled artifacts keyed by path, name, version and profile; compiled ones win."""
    return last_wins([cached, compiled], ["path", "name", "version", "profile"])

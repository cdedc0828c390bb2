"""Version and profile solving: which compiler and settings every input file gets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from buildlens.functions.versions import matches, merge_requirements, parse_requirement, satisfies
from buildlens.operators.graph import closure, spread_bounds
from buildlens.storage import Written


def available_versions(installed: DataFrame, remote: DataFrame | None = None) -> DataFrame:
    """(v, installed): installed versions, and remote ones (v) that aren't installed."""
    own = installed.select("v").distinct().withColumn("installed", F.lit(True))
    if remote is None:
        return own
    return own.unionByName(remote.select("v").distinct().join(own.select("v"), "v", "left_anti").withColumn("installed", F.lit(False)))


def parsed_requirements(files: DataFrame) -> DataFrame:
    """(path, requirement) of files (path, version_text). Each distinct text, of which there are few, is parsed once."""
    texts = Written(files.select("version_text").where("version_text is not null").distinct().select("version_text", parse_requirement(F.col("version_text")).alias("requirement")), "requirements").df
    return files.select("path", "version_text").join(texts, "version_text", "left").select("path", "requirement")


def version_requirements(files: DataFrame, restrictions: DataFrame) -> DataFrame:
    """(path, requirement): a file's own requirement and the project's for it; null where there is neither."""
    extra = restrictions.select("path", F.col("requirement").alias("extra"))
    return files.select("path", "requirement").join(extra, "path", "left").select("path", merge_requirements(F.col("requirement"), F.col("extra")).alias("requirement"))


def check_available(requirements: DataFrame, versions: DataFrame) -> DataFrame:
    """(path, ok, error) whether any version meets the file's requirement: error is null, "not installed" where one that
    isn't installed does, or "no version". Versions (v, perhaps installed) are few and go along as one array."""
    installed = F.col("installed") if "installed" in versions.columns else F.lit(True)
    every = versions.agg(F.collect_list(F.struct("v", installed.alias("installed"))).alias("all"))
    rows = requirements.withColumn("_all", every.scalar()).withColumn("_fit", F.filter("_all", lambda c: matches(F.col("requirement"), c["v"])))
    own, any_ = F.exists("_fit", lambda c: c["installed"]), F.size("_fit") > 0
    return rows.select("path", any_.alias("ok"), F.when(own, F.lit(None).cast("string")).when(any_, "not installed").otherwise("no version").alias("error"))


def file_candidates(requirements: DataFrame, versions: DataFrame) -> DataFrame:
    """(path, candidates array<struct<installed, v>>) of each file by itself."""
    every = versions.agg(F.collect_list(F.struct("installed", "v")).alias("all"))
    distinct = requirements.select("requirement").distinct().withColumn("_all", every.scalar())
    found = Written(distinct.select(F.col("requirement").alias("_r"), F.filter("_all", lambda c: matches(F.col("requirement"), c["v"])).alias("candidates")), "candidates").df
    return requirements.join(found, F.col("requirement").eqNullSafe(F.col("_r"))).select("path", "candidates")


def compatible_versions(requirements: DataFrame, edges: DataFrame, inputs: DataFrame, versions: DataFrame) -> DataFrame:
    """(path, candidates) of each input (path): versions that it and all it imports can take, by version.

    Requirements are intervals, and so is their conjunction over a closure: bounds that move along the edges.
    """
    nodes = edges.select(F.col("src").alias("path")).unionByName(edges.select(F.col("dst").alias("path"))).distinct()
    own = requirements.select("path", "requirement.lo", "requirement.hi")
    need = spread_bounds(edges, own.unionByName(nodes.join(own, "path", "left_anti"), allowMissingColumns=True))
    need = need.select("path", F.when(F.col("lo").isNotNull() | F.col("hi").isNotNull(), F.struct("lo", "hi")).alias("requirement"))
    return file_candidates(inputs.select("path").distinct().join(need, "path", "left"), versions).select("path", F.array_sort(F.transform("candidates", lambda c: F.struct(c["v"].alias("v"), c["installed"].alias("installed")))).alias("candidates"))


def conflicts(requirements: DataFrame, edges: DataFrame, candidates: DataFrame) -> DataFrame:
    """(path, first, second) for inputs without a candidate: the files whose requirements exclude each other most,
    that with the highest lower bound and that with the lowest upper one."""
    stuck = candidates.where(F.size("candidates") == 0).select(F.col("path").alias("root"))
    rows = closure(edges, stuck).join(requirements.withColumnRenamed("path", "node"), "node").where("requirement is not null")
    return rows.groupBy("root").agg(F.max(F.struct("requirement.lo", "node"))["node"].alias("first"), F.min(F.when(F.col("requirement.hi").isNotNull(), F.struct("requirement.hi", "node")))["node"].alias("second")).select(F.col("root").alias("path"), "first", "second")


def best_candidate(candidates):
    """Of array<struct<v, installed>>: the highest installed version, or else the highest."""
    own = F.filter(candidates, lambda c: c["installed"])
    return F.when(F.size(own) > 0, F.array_max(own)).otherwise(F.array_max(candidates))["v"]


def rechecked_versions(chosen: DataFrame, edges: DataFrame, requirements: DataFrame) -> DataFrame:
    """(path, v, ok): whether each chosen version (path, v) also meets what all that the file imports demands now; where
    several versions were chosen, files for which it doesn't have to be solved again."""
    own = requirements.select("path", "requirement.lo", "requirement.hi")
    need = spread_bounds(edges, own).select("path", F.struct("lo", "hi").alias("requirement"))
    return chosen.join(need, "path", "left").select("path", "v", matches(F.col("requirement"), F.col("v")).alias("ok"))


def chosen_versions(candidates: DataFrame) -> DataFrame:
    """(path, v) of each input that has candidates.

    One version that all inputs can take is preferred, else inputs choose in turn, in path order: of the versions that
    earlier ones have chosen the highest they can take, or else their best. That turn is sequential by nature; it runs
    over distinct candidate sets, which are as few as the combinations of requirements, not over files.
    """
    some = candidates.where(F.size("candidates") > 0)
    own = some.select("path", "candidates", best_candidate(F.col("candidates")).alias("v"))
    sets = own.groupBy("candidates").agg(F.min("path").alias("first"), F.count(F.lit(1)).alias("n"), F.first("v").alias("v")).orderBy("first").collect()
    if len({tuple(r["v"]) for r in sets}) <= 1:
        return own.select("path", "v")
    rank = lambda c: (c["installed"], tuple(c["v"]))
    common = set.intersection(*[{rank(c) for c in r["candidates"]} for r in sets])
    taken: list[tuple] = []  # (path from which on it is chosen, version): new ones come at the first path of a set only
    for r in sets:
        able = {rank(c) for c in r["candidates"]}
        if common:
            taken = [(sets[0]["first"], max(common))]
        elif not any(x in able for _, x in taken):
            taken.append((r["first"], max(able)))
    rows = []
    for r in sets:
        able, steps = {rank(c) for c in r["candidates"]}, []
        for since, x in taken:
            if x in able and (not steps or x > steps[-1][1]):
                steps.append((since, x))
        rows.append((r["candidates"], [(since, list(x[1])) for since, x in steps]))
    spark = candidates.sparkSession
    plan = spark.createDataFrame(rows, f"candidates {own.schema['candidates'].dataType.simpleString()}, steps array<struct<since: string, v: array<int>>>")
    chosen = F.element_at(F.filter("steps", lambda s: s["since"] <= F.col("path")), -1)
    return own.select("path", "candidates").join(plan, "candidates").select("path", chosen["v"].alias("v"))


def compatible_profiles(restrictions: DataFrame, edges: DataFrame, inputs: DataFrame, profiles: DataFrame) -> DataFrame:
    """(path, profile): the first profile, by ordinal, that meets the restrictions of the input and all it imports.

    restrictions: path, evm_min, evm_max (ranks), via_ir, runs_min, runs_max; profiles: ordinal, profile, evm, via_ir,
    runs, optimizer. Profiles are configuration; inputs without a fitting one are left out.
    """
    reach = closure(edges, inputs.select(F.col("path").alias("root")))
    need = reach.join(restrictions.withColumnRenamed("path", "node"), "node").groupBy("root").agg(
        F.max("evm_min").alias("evm_min"), F.min("evm_max").alias("evm_max"), F.max("runs_min").alias("runs_min"), F.min("runs_max").alias("runs_max"), F.bool_or("via_ir").alias("any_ir"), F.bool_and("via_ir").alias("all_ir")
    )
    every = profiles.agg(F.array_sort(F.collect_list(F.struct("ordinal", "profile", "evm", "via_ir", "runs", "optimizer"))).alias("all"))

    def fits(p):
        ir = F.coalesce(F.col("any_ir") == F.col("all_ir"), F.lit(True)) & (F.col("any_ir").isNull() | (F.col("any_ir") == p["via_ir"]))
        on = ~F.coalesce(F.col("runs_min") > 0, F.lit(False)) | p["optimizer"]
        return satisfies(F.col("evm_min"), F.col("evm_max"), p["evm"]) & satisfies(F.col("runs_min"), F.col("runs_max"), p["runs"]) & ir & on

    rows = inputs.select("path").distinct().join(need, F.col("path") == F.col("root"), "left").withColumn("_all", every.scalar()).withColumn("first", F.get(F.filter("_all", fits), 0))
    return rows.where("first is not null").select("path", F.col("first.profile").alias("profile"))


def inputs_by_language(inputs: DataFrame) -> DataFrame:
    """(language, paths) in path order."""
    return inputs.groupBy("language").agg(F.array_sort(F.collect_list("path")).alias("paths"))

"""Further registered queries: names, lookups, unnesting, settings, cache upkeep, scans and sinks, planning."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import functions as F

from buildlens.functions import bytecode, paths, solidity, versions
from buildlens.operators import ast, edits, filters, graph, incremental, outputs, resolve, solve, sourcemap
from buildlens.plans import planner, queries
from buildlens.plans.queries import _CLOSURE, _TREE, ARTIFACTS, DIAGNOSTICS, EDGES, ORACLE_SQL, QUERIES, SOURCES, _query
from buildlens.sources import json_parts, remappings, scan, sinks
from buildlens.storage import Written, shared_dir

_BEFORE = set(QUERIES)

#: One artifact for each key; with build and place.
KEYED = f"SELECT path, name, version, profile, max(artifact_path) AS artifact_path, max(build_id) AS build_id, max(ordinal) AS ordinal FROM ({ARTIFACTS}) AS a GROUP BY path, name, version, profile"


def _case(k: str, *values: str) -> str:
    return f"CASE {k} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values[:-1])) + f" ELSE {values[-1]} END"


# Names and paths


@_query(
    f"""SELECT id, path AS slashed, CASE WHEN starts_with(path, 'src/d' || CAST(id % 3 AS VARCHAR) || '/') THEN substr(path, 8) ELSE path END AS stripped,
      CASE id % 4 WHEN 0 THEN '/abs/' || path WHEN 1 THEN path WHEN 2 THEN 'root/' || path ELSE 'root/' || path END AS joined,
      regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\\.[^.]*$', '') || '.json:' || brand AS slug,
      regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\\.[^.]*$', '') || '.0.' || CAST(size % 9 AS VARCHAR) || '.' || CAST(id % 30 AS VARCHAR) || '.json:' || brand AS versioned,
      CASE WHEN id % 5 = 0 THEN brand ELSE path || ':' || brand END AS identifier, {_case("id % 5", "'Vyper'", "'Vyper'", "NULL", "CASE WHEN ends_with(path, '.yul') THEN 'Yul' ELSE 'Solidity' END")} AS language, regexp_extract(path, '\\.([^.]*)$', 1) AS extension FROM sources""",
    sources=SOURCES,
)
def path_names(spark, sources):
    """Slashes, prefixes, joins, slugs, identifiers, extensions and languages of paths."""
    p, id_ = F.col("path"), F.col("id")
    base = F.when(id_ % 4 == 1, "").when(id_ % 4 == 2, "root").otherwise("root/")
    lang = F.when(id_ % 5 == 0, F.concat(p, F.lit(".vy"))).when(id_ % 5 == 1, F.concat(p, F.lit(".vyi"))).when(id_ % 5 == 2, F.concat(p, F.lit(".txt"))).otherwise(p)
    v = F.array(F.lit(0), F.col("size") % 9, (id_ % 30).cast("int"))
    return sources.select(
        "id", paths.slash_path(F.replace(p, F.lit("/"), F.lit("\\"))).alias("slashed"), paths.strip_prefix(p, F.concat(F.lit("src/d"), (id_ % 3).cast("string"))).alias("stripped"),
        paths.join_path(base, F.when(id_ % 4 == 0, F.concat(F.lit("/abs/"), p)).otherwise(p)).alias("joined"), paths.slug(p, F.col("brand")).alias("slug"), paths.slug_versioned(p, F.col("brand"), v).alias("versioned"),
        paths.identifier(F.when(id_ % 5 != 0, p), F.col("brand")).alias("identifier"), paths.guess_language(lang).alias("language"), paths.extension(p).alias("extension"),
    )


@_query(
    """SELECT id, CASE id % 5 WHEN 0 THEN 'c' || CAST(size AS VARCHAR) END AS context, CASE id % 5 WHEN 0 THEN '@a/' WHEN 1 THEN '@b' WHEN 4 THEN 'x' END AS name, CASE id % 5 WHEN 0 THEN path WHEN 1 THEN 'lib/' || path WHEN 4 THEN 'y=z' END AS path,
      CASE id % 3 WHEN 0 THEN path WHEN 1 THEN 'p' END AS info_path, brand AS info_name FROM sources""",
    sources=SOURCES,
)
def parsed_names(spark, sources):
    """Remappings and contract names as users write them."""
    k = F.col("id") % 5
    text = F.when(k == 0, F.concat(F.lit("c"), F.col("size").cast("string"), F.lit(":@a/="), "path")).when(k == 1, F.concat(F.lit("@b=lib/"), "path")).when(k == 2, F.concat(F.lit("no sign "), "path")).when(k == 3, F.concat(F.lit(" ="), "path")).otherwise("x=y=z")
    info = F.when(F.col("id") % 3 == 0, F.concat("path", F.lit(":"), "brand")).when(F.col("id") % 3 == 1, F.concat(F.lit("drive:p:"), "brand")).otherwise(F.col("brand"))
    r, i = paths.parse_remapping(text), paths.parse_contract_info(info)
    return sources.select("id", r["context"].alias("context"), r["name"].alias("name"), r["path"].alias("path"), i["path"].alias("info_path"), i["name"].alias("info_name"))


# Lookups


@_query(
    """WITH one AS (SELECT 'name' AS how, * FROM artifacts WHERE name = 'N3' ORDER BY path, version, profile LIMIT 1), two AS (SELECT 'file' AS how, * FROM artifacts WHERE name = 'N3' AND path = (SELECT max(path) FROM artifacts WHERE name = 'N3') ORDER BY version, profile LIMIT 1),
    three AS (SELECT 'version' AS how, * FROM artifacts WHERE name = 'N2' AND version = '0.8.1' ORDER BY path, version, profile LIMIT 1), four AS (SELECT 'profile' AS how, * FROM artifacts WHERE name = 'N2' AND profile = 'none' LIMIT 1), five AS (SELECT 'info' AS how, * FROM artifacts WHERE name = 'N1' ORDER BY path, version, profile LIMIT 1),
    six AS (SELECT 'read' AS how, * FROM artifacts WHERE name = 'N3' AND path = (SELECT max(path) FROM artifacts WHERE name = 'N3') ORDER BY version, profile LIMIT 1)
    SELECT how, path, name, version, artifact_path FROM (SELECT * FROM one UNION ALL SELECT * FROM two UNION ALL SELECT * FROM three UNION ALL SELECT * FROM four UNION ALL SELECT * FROM five UNION ALL SELECT * FROM six)""",
    artifacts=KEYED,
)
def found_artifacts(spark, artifacts):
    """The first artifact of a name, and of a file, version or profile."""
    last = artifacts.where("name = 'N3'").agg(F.max("path")).first()[0] or ""
    tries = {"name": outputs.find(artifacts, "N3"), "file": outputs.find(artifacts, "N3", last), "version": outputs.find(artifacts, "N2", version="0.8.1"), "profile": outputs.find(artifacts, "N2", profile="none"), "info": outputs.find_by_info(artifacts, "N1"), "read": scan.read_one(artifacts, last, "N3")}
    out = None
    for how, found in tries.items():
        row = found.select(F.lit(how).alias("how"), "path", "name", "version", "artifact_path")
        out = row if out is None else out.unionByName(row)
    return out


@_query(
    """WITH first AS (SELECT path, version, profile FROM artifacts WHERE name = 'N3' ORDER BY path, version, profile LIMIT 1), named AS (SELECT path, version, profile FROM artifacts WHERE name = 'N4' ORDER BY path, version, profile LIMIT 1)
    SELECT 'taken' AS part, a.* EXCLUDE (ordinal) FROM artifacts a JOIN first USING (path, version, profile) WHERE name = 'N3' UNION ALL
    SELECT 'rest', a.* EXCLUDE (ordinal) FROM artifacts a WHERE NOT (name = 'N3' AND EXISTS (SELECT 1 FROM first f WHERE f.path = a.path AND f.version = a.version AND f.profile = a.profile)) UNION ALL
    SELECT 'info', a.* EXCLUDE (ordinal) FROM artifacts a JOIN named USING (path, version, profile) WHERE name = 'N4'""",
    artifacts=KEYED,
)
def taken_artifacts(spark, artifacts):
    """An artifact taken out, and all others."""
    one, rest = outputs.take(artifacts, "N3")
    info, _ = outputs.take_by_info(artifacts, "N4")
    tag = lambda df, part: df.select(F.lit(part).alias("part"), *[c for c in artifacts.columns if c != "ordinal"])
    return tag(one, "taken").unionByName(tag(rest, "rest")).unionByName(tag(info, "info"))


@_query(
    """WITH fresh AS (SELECT * FROM artifacts WHERE ordinal % 3 = 0), cached AS (SELECT * FROM artifacts WHERE ordinal % 3 <> 0), every AS (SELECT *, 0 AS o FROM fresh UNION ALL SELECT *, 1 FROM cached),
    best AS (SELECT *, row_number() OVER (PARTITION BY path, name ORDER BY o, version, profile) AS n FROM every), by_name AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY path, version, profile) AS n FROM artifacts)
    SELECT 'pair' AS how, path, name, version, CASE o WHEN 0 THEN 'fresh' ELSE 'cached' END AS origin FROM best WHERE n = 1 UNION ALL SELECT 'name', path, name, version, 'any' FROM by_name WHERE n = 1""",
    artifacts=KEYED,
)
def preferred_artifacts(spark, artifacts):
    """Fresh artifacts before cached ones; the first of each name."""
    best = outputs.fresh_first(artifacts.where("ordinal % 3 = 0"), artifacts.where("ordinal % 3 <> 0"), ["path", "name"])
    first = outputs.first_by_name(artifacts).select(F.lit("name").alias("how"), "path", "name", "version", F.lit("any").alias("origin"))
    return best.select(F.lit("pair").alias("how"), "path", "name", "version", "origin").unionByName(first)


@_query("SELECT ordinal AS source_id, path, ordinal % 10 = 3 AS taken FROM artifacts", artifacts=KEYED)
def sources_by_id(spark, artifacts):
    """Sources with a compiler's id taken out, one id after the other."""
    s = artifacts.select((F.col("ordinal") % 10).alias("source_id"), "path", F.col("ordinal"))
    one, rest = outputs.take_source(s, 3)
    return one.withColumn("taken", F.lit(True)).unionByName(rest.withColumn("taken", F.lit(False))).select(F.col("ordinal").alias("source_id"), "path", "taken")


# Unnesting and merging


@_query("SELECT path, name, version, profile, artifact_path AS artifact, version = '0.8.1' AS wanted FROM artifacts", artifacts=KEYED)
def unnested_artifacts(spark, artifacts):
    """Artifacts out of maps by file and name, and those of a version."""
    one = F.struct("version", "profile", F.col("artifact_path").alias("artifact"))
    names = artifacts.groupBy("path", "name").agg(F.collect_list(one).alias("all"))
    files = names.groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("name", "all"))).alias("m"))
    rows = outputs.explode_artifacts(files.select(F.create_map("path", "m").alias("artifacts")))
    wanted = outputs.artifacts_for_version(rows, "0.8.1").withColumn("wanted", F.lit(True))
    return outputs.combined(wanted, rows.where("version <> '0.8.1'").withColumn("wanted", F.lit(False)))


@_query("SELECT build_id AS job, path, name, string_agg(version, ',' ORDER BY version) AS versions FROM artifacts GROUP BY ALL", artifacts=KEYED)
def unnested_contracts(spark, artifacts):
    """Contracts out of each job's maps by file and name."""
    names = artifacts.groupBy("build_id", "path", "name").agg(F.array_join(F.array_sort(F.collect_list("version")), ",").alias("versions"))
    files = names.groupBy("build_id", "path").agg(F.map_from_entries(F.collect_list(F.struct("name", "versions"))).alias("by_name"))
    jobs = files.groupBy(F.col("build_id").alias("job")).agg(F.map_from_entries(F.collect_list(F.struct("path", "by_name"))).alias("contracts"))
    return outputs.explode_contracts(jobs).withColumnRenamed("contract", "versions")


@_query(
    """WITH parts AS (SELECT *, 0 AS part FROM artifacts WHERE ordinal % 2 = 0 UNION ALL SELECT * REPLACE ('new/' || artifact_path AS artifact_path), 1 FROM artifacts WHERE ordinal % 3 = 0 UNION ALL SELECT * REPLACE ('last/' || artifact_path AS artifact_path), 2 FROM artifacts WHERE ordinal % 5 = 0)
    SELECT path, name, version, profile, arg_max(artifact_path, part) AS artifact_path FROM parts GROUP BY ALL""",
    artifacts=KEYED,
)
def merged_artifacts(spark, artifacts):
    """Artifacts of several runs; a later run's stands for earlier ones of its key."""
    pick = lambda k, lead: artifacts.where(f"ordinal % {k} = 0").withColumn("artifact_path", F.concat(F.lit(lead), "artifact_path")).drop("ordinal", "build_id")
    return outputs.artifacts_with_sources(outputs.last_wins([pick(2, ""), pick(3, "new/")], incremental.KEY), pick(5, "last/"))


@_query("SELECT path, name, string_agg(version || '=' || build_id, ',' ORDER BY version, build_id) AS versions FROM artifacts GROUP BY path, name", artifacts=KEYED)
def aggregated_outputs(spark, artifacts):
    """What all jobs gave for a contract, by version."""
    jobs = [artifacts.where(f"ordinal % 3 = {k}").select("path", "name", "version", "build_id") for k in range(3)]
    got = outputs.aggregated(jobs, ["path", "name"], ["version"])
    return got.select("path", "name", F.array_join(F.transform("versions", lambda v: F.concat_ws("=", v["version"], v["build_id"])), ",").alias("versions"))


@_query("SELECT build_id, string_agg(ordinal || ':' || path, ',' ORDER BY ordinal) AS sources FROM artifacts WHERE starts_with(path, 'src/d1') GROUP BY build_id", artifacts=KEYED)
def sources_of_builds(spark, artifacts):
    """Which source each id of a build stands for, of the sources that were inputs."""
    got = outputs.build_sources(artifacts.select("build_id", F.col("ordinal").alias("source_id"), "path"), artifacts.where("startswith(path, 'src/d1')").select("path"))
    return got.select("build_id", F.array_join(F.transform(F.map_entries("source_id_to_path"), lambda e: F.concat_ws(":", e["key"].cast("string"), e["value"])), ",").alias("sources"))


@_query("SELECT id, md5('f' || chr(0) || '0.8.' || CAST(size AS VARCHAR) || chr(0) || content) AS build_id, path FROM sources WHERE id % 4 <> 0", sources=SOURCES)
def build_ids(spark, sources):
    """Ids of builds from what went into them; results with an error would fail."""
    rows = sources.select("id", outputs.build_id(F.lit("f"), F.concat(F.lit("0.8."), F.col("size").cast("string")), F.col("content")).alias("build_id"), "path", F.lit(None).cast("string").alias("error"))
    return outputs.all_or_error(rows.where("id % 4 <> 0"))


@_query("SELECT language, count(*) AS n, min(path) AS first, max(path) AS last FROM (SELECT path, CASE WHEN ends_with(path, '.yul') THEN 'Yul' ELSE 'Solidity' END AS language FROM sources) GROUP BY language", sources=SOURCES)
def inputs_by_language(spark, sources):
    got = solve.inputs_by_language(sources.select("path", paths.guess_language(F.col("path")).alias("language")))
    return got.select("language", F.size("paths").cast("long").alias("n"), F.get("paths", 0).alias("first"), F.element_at("paths", -1).alias("last"))


@_query(
    """SELECT path, name, version, string_split(path, '/')[-1] || '/' || name || '.json' AS sized, length(path) - length(replace(path, '/', '')) + 1 AS depth, version <> '0.8.0' AS standalone, CASE WHEN ordinal % 2 = 0 THEN 'abi' END AS abi, CASE WHEN ordinal % 3 = 0 THEN 'ir' END AS ir FROM artifacts""",
    artifacts=KEYED,
)
def artifact_fields(spark, artifacts):
    """Depths of files, sources without a contract, and the outputs that were asked for."""
    sources = artifacts.select("path", "version", F.lit(True).alias("has_ast")).distinct()
    alone = outputs.standalone_sources(sources, artifacts.where("version = '0.8.0'")).withColumn("standalone", F.lit(True)).drop("has_ast")
    c = F.struct(F.lit("abi").alias("abi"), F.lit("ir").alias("ir"))
    wanted = F.array_compact(F.array(F.when(F.col("ordinal") % 2 == 0, "abi"), F.when(F.col("ordinal") % 3 == 0, "ir")))
    rows = artifacts.join(alone, ["path", "version"], "left")
    return rows.select("path", "name", "version", paths.output_file(F.col("path"), F.col("name")).alias("sized"), outputs.depth_order(F.col("path"))["depth"].alias("depth"), F.coalesce("standalone", F.lit(False)).alias("standalone"), outputs.selected_artifact(c, ["abi", "ir"], wanted)["abi"].alias("abi"), outputs.selected_artifact(c, ["abi", "ir"], wanted)["ir"].alias("ir"))


@_query(
    """SELECT id, 'hh-sol-artifact-1' AS format, brand AS name, path AS source, CASE WHEN id % 2 = 0 THEN '[1]' ELSE '[]' END AS abi, CASE WHEN id % 3 = 0 THEN '0x' ELSE '60' END AS bytecode, '{}' AS links, CASE WHEN id % 2 = 0 THEN '[1]' END AS compact_abi FROM sources""",
    sources=SOURCES,
)
def shaped_artifacts(spark, sources):
    """Artifacts in the shapes of two tools."""
    c = F.struct(F.when(F.col("id") % 2 == 0, "[1]").alias("abi"), F.when(F.col("id") % 3 != 0, "60").alias("bytecode"), F.lit(None).cast("string").alias("deployed"), F.lit(None).cast("string").alias("links"), F.lit(None).cast("string").alias("deployed_links"))
    h, k = outputs.hardhat_artifact(F.col("path"), F.col("brand"), c), outputs.compact_artifact(c)
    return sources.select("id", h["_format"].alias("format"), h["contractName"].alias("name"), h["sourceName"].alias("source"), h["abi"].alias("abi"), h["bytecode"].alias("bytecode"), h["deployedLinkReferences"].alias("links"), k["abi"].alias("compact_abi"))


@_query(
    """WITH named AS (SELECT path, name, version, count(DISTINCT version) OVER (PARTITION BY path, name) > 1 AS several, artifact_path, ordinal FROM artifacts), fresh AS (SELECT path, name, version, artifact_path, ordinal % 2 = 0 AS cached, regexp_extract(path, '([^/]*)$', 1) || '/' || name || CASE WHEN several THEN '.' || version ELSE '' END || '.json' AS file FROM named)
    SELECT path, name, version, CASE WHEN cached THEN artifact_path ELSE file END AS file FROM fresh""",
    artifacts=KEYED,
)
def artifact_places(spark, artifacts):
    """Cached artifacts keep their file; new ones get names that tell versions apart, those of cached ones too."""
    key = artifacts.select(*incremental.KEY)
    return outputs.artifact_paths(key, artifacts.where("ordinal % 2 = 0")).select("path", "name", "version", "file")


# Versions and settings


_OPS = ["", "^", "~", ">=", "<=", ">", "<", "="]


@_query(
    """WITH r AS (SELECT id, size % 8 AS op, id % 2 AS a, size % 10 AS b, id % 30 AS c FROM sources), x AS (SELECT *, [a, b, c] AS v, [a, b, c + 1] AS above FROM r)
    SELECT id, CASE WHEN op IN (4, 6) THEN '0.0.0' WHEN op = 5 THEN array_to_string(above, '.') ELSE array_to_string(v, '.') END AS lo,
      CASE WHEN op IN (3, 5) THEN NULL WHEN op = 6 THEN array_to_string(v, '.') WHEN op = 1 THEN CASE WHEN a > 0 THEN '2.0.0' WHEN b > 0 THEN '0.' || (b + 1) || '.0' ELSE array_to_string(above, '.') END WHEN op = 2 THEN a || '.' || (b + 1) || '.0' ELSE array_to_string(above, '.') END AS hi,
      CASE op WHEN 4 THEN true WHEN 6 THEN [0, 5, 9] < v WHEN 5 THEN [0, 5, 9] > v WHEN 3 THEN [0, 5, 9] >= v WHEN 1 THEN [0, 5, 9] >= v AND a = 0 AND (b = 5 OR (b = 0 AND false)) WHEN 2 THEN [0, 5, 9] >= v AND a = 0 AND b = 5 ELSE [0, 5, 9] = v END AND (op <> 4 OR [0, 5, 9] <= v) AS fits FROM x""",
    sources=SOURCES,
)
def requirement_intervals(spark, sources):
    """Requirements of every operator as intervals, and whether a version lies in them."""
    op = F.element_at(F.array(*map(F.lit, _OPS)), (F.col("size") % 8 + 1).cast("int"))
    text = F.concat(op, (F.col("id") % 2).cast("string"), F.lit("."), (F.col("size") % 10).cast("string"), F.lit("."), (F.col("id") % 30).cast("string"))
    rows = sources.select("id", F.col("id").cast("string").alias("path"), text.alias("version_text"))
    got = rows.select("id", "path").join(solve.parsed_requirements(rows), "path")
    join = lambda c: F.array_join(F.col(f"requirement.{c}").cast("array<string>"), ".")
    return got.select("id", join("lo").alias("lo"), join("hi").alias("hi"), versions.matches(F.col("requirement"), versions.version(0, 5, 9)).alias("fits"))


@_query(
    """WITH r AS (SELECT path, CASE WHEN id % 3 = 0 THEN NULL ELSE size % 10 END AS lo1, CASE WHEN id % 3 = 1 THEN NULL ELSE id % 12 END AS lo2 FROM sources), m AS (SELECT path, greatest(lo1, lo2) AS lo FROM r)
    SELECT path, lo AS minor, coalesce(lo <= 9, true) AS ok, CASE WHEN coalesce(lo <= 7, true) THEN NULL WHEN lo <= 9 THEN 'not installed' ELSE 'no version' END AS error FROM m""",
    sources=SOURCES,
)
def available_requirements(spark, sources):
    """A file's requirement with the project's, and whether any version, or only one that isn't installed, meets it."""
    at = lambda c: F.when(c.isNotNull(), F.struct(F.array(F.lit(0), c.cast("int"), F.lit(0)).alias("lo"), F.lit(None).cast("array<int>").alias("hi")))
    files = sources.select("path", at(F.when(F.col("id") % 3 != 0, F.col("size") % 10)).alias("requirement"))
    project = sources.select("path", at(F.when(F.col("id") % 3 != 1, F.col("id") % 12)).alias("requirement"))
    merged = Written(solve.version_requirements(files, project), "merged").df
    known = spark.createDataFrame([([0, 7, 0], True), ([0, 9, 0], False)], "v array<int>, installed boolean")
    return merged.join(solve.check_available(merged, known), "path").select("path", F.get("requirement.lo", 1).alias("minor"), "ok", "error")


@_query(
    """WITH v AS (SELECT id, size % 10 AS b, CAST(id % 31 AS INT) AS c FROM sources)
    SELECT id, b > 7 OR (b = 7 AND c >= 5) AS via_ir, b > 6 OR (b = 6 AND c >= 0) AS bytecode_hash, b > 8 OR (b = 8 AND c >= 18) AS cbor, CASE WHEN id % 3 = 0 THEN 'abi' ELSE 'evm.bytecode,ir' END AS selection,
      CASE WHEN b >= 4 THEN 'src' END AS search_paths, CASE WHEN id % 3 = 0 THEN 'abi' ELSE 'evm.bytecode' END AS vyper,
      CASE WHEN b < 4 OR (b = 4 AND c < 21) THEN NULL WHEN b = 4 OR (b = 5 AND c < 5) THEN 'byzantium' WHEN b = 5 AND c < 14 THEN 'petersburg' WHEN b < 8 OR (b = 8 AND c < 5) THEN 'istanbul' WHEN b = 8 AND c < 7 THEN 'berlin' WHEN b = 8 AND c < 18 THEN 'london' WHEN b = 8 AND c < 20 THEN 'paris' WHEN b = 8 AND c < 25 THEN 'shanghai' WHEN b = 8 AND c < 28 THEN 'cancun' ELSE 'prague' END AS evm FROM v""",
    sources=SOURCES,
)
def sanitised_settings(spark, sources):
    """Settings that a compiler release knows, its outputs, and the EVM version it targets by itself."""
    v = F.array(F.lit(0), F.col("size") % 10, (F.col("id") % 31).cast("int"))
    on = lambda name: versions.sanitised(name, F.lit(True), v).isNotNull()
    wanted = F.when(F.col("id") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("evm.bytecode"), F.lit("ir")))
    vyper = versions.sanitised_vyper(F.when(F.col("id") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("evm.bytecode"), F.lit("evm.bytecode.sourceMap"))), F.lit("src"), v)
    return sources.select("id", on("via_ir").alias("via_ir"), on("bytecode_hash").alias("bytecode_hash"), on("cbor_metadata").alias("cbor"), F.array_join(versions.sanitised_output_selection(wanted, ["ewasm"]), ",").alias("selection"), vyper["search_paths"].alias("search_paths"), F.array_join(vyper["selection"], ",").alias("vyper"), versions.default_evm(v).alias("evm"))


_RESTRICTION = """SELECT id, path, size, CASE WHEN id % 3 = 0 THEN NULL ELSE CAST(size % 7 AS INT) END AS evm_min, CASE WHEN id % 4 = 0 THEN NULL ELSE CAST(size % 5 + 5 AS INT) END AS evm_max, CASE id % 5 WHEN 0 THEN true WHEN 1 THEN false ELSE NULL END AS via_ir,
  CASE WHEN id % 6 = 0 THEN 100 ELSE NULL END AS runs_min, CASE WHEN id % 7 = 0 THEN 200 ELSE NULL END AS runs_max, CASE WHEN id % 11 = 0 THEN 'ipfs' ELSE NULL END AS bytecode_hash FROM ({s}) AS s""".format(s=SOURCES)


@_query(
    """WITH p AS (SELECT a.id, a.evm_min AS l1, a.evm_max AS h1, a.via_ir AS ir1, a.runs_min AS r1, a.runs_max AS m1, a.bytecode_hash AS b1, b.evm_min AS l2, b.evm_max AS h2, b.via_ir AS ir2, b.runs_min AS r2, b.runs_max AS m2, b.bytecode_hash AS b2 FROM r a JOIN r b ON b.id = a.id + 1),
    m AS (SELECT *, greatest(l1, l2) AS lo, least(h1, h2) AS hi, greatest(r1, r2) AS rl, least(m1, m2) AS rh, coalesce(ir1, ir2) AS ir, coalesce(b1, b2) AS bh FROM p)
    SELECT id, lo AS evm_min, hi AS evm_max, ir AS via_ir, rl AS runs_min, rh AS runs_max, bh AS bytecode_hash,
      coalesce(6 >= lo, true) AND coalesce(6 <= hi, true) AND coalesce(ir = (id % 2 = 0), true) AND coalesce(bh = 'ipfs', true) AND coalesce(150 >= rl, true) AND coalesce(150 <= rh, true) AND (coalesce(rl > 0, false) = false OR id % 3 = 0) AS ok
    FROM m WHERE coalesce(lo <= hi, true) AND coalesce(rl <= rh, true) AND coalesce(ir1 = ir2, true) AND coalesce(b1 = b2, true)""",
    r=_RESTRICTION,
)
def settings_restrictions(spark, r):
    """Restrictions of two files merged, and whether settings meet them."""
    fields = ["evm_min", "evm_max", "via_ir", "runs_min", "runs_max", "bytecode_hash"]
    a, b = r.select("id", F.struct(*fields).alias("a")), r.select((F.col("id") - 1).alias("id"), F.struct(*fields).alias("b"))
    m = a.join(b, "id").select("id", versions.merge_settings_restrictions(F.col("a"), F.col("b")).alias("r")).where("r is not null")
    ok = filters.satisfies_restrictions(F.lit(6), F.col("id") % 2 == 0, F.lit(150), F.col("id") % 3 == 0, F.lit("ipfs"), F.col("r"))
    return m.select("id", *[F.col(f"r.{f}").alias(f) for f in fields], ok.alias("ok"))


_PROFILES = [(0, "default", 7, False, 200, True), (1, "old", 2, False, 50, False), (2, "ir", 9, True, 150, True)]


@_query(
    f"RECURSIVE WITH {_CLOSURE}, every AS (SELECT root, node FROM reach UNION SELECT path, path FROM r), need AS (SELECT root, max(evm_min) AS l, min(evm_max) AS h, max(runs_min) AS rl, min(runs_max) AS rh, bool_or(via_ir) AS any_ir, bool_and(via_ir) AS all_ir FROM every JOIN r ON node = path GROUP BY root),"
    + " p(ordinal, profile, evm, ir, runs, opt) AS (VALUES " + ", ".join(f"({o}, '{n}', {e}, {str(i).lower()}, {u}, {str(t).lower()})" for o, n, e, i, u, t in _PROFILES)
    + """), fits AS (SELECT root, profile, row_number() OVER (PARTITION BY root ORDER BY ordinal) AS n FROM need, p WHERE coalesce(evm >= l, true) AND coalesce(evm <= h, true) AND coalesce(runs >= rl, true) AND coalesce(runs <= rh, true) AND (any_ir IS NULL OR (any_ir = all_ir AND any_ir = ir)) AND (coalesce(rl > 0, false) = false OR opt))
    SELECT root AS path, profile FROM fits WHERE n = 1""",
    edges=EDGES,
    r=_RESTRICTION,
)
def chosen_profiles(spark, edges, r):
    """The first settings profile that meets what a file and all its imports demand."""
    profiles = spark.createDataFrame(_PROFILES, "ordinal int, profile string, evm int, via_ir boolean, runs int, optimizer boolean")
    return solve.compatible_profiles(r, edges, r, profiles)


@_query(
    """SELECT id, id % 2 = 0 AND size % 3 <> 2 AS cached, size % 3 = 0 AS ast, CASE size % 3 WHEN 0 THEN 2 ELSE 1 END AS n_outputs, id % 5 = 0 OR size % 3 = 2 AS lacks FROM sources""",
    sources=SOURCES,
)
def selections(spark, sources):
    """Output selections: whether cached outputs do, whether a syntax tree is asked for, as rows, and against an artifact."""
    k = F.col("size") % 3
    pick = F.when(k == 0, F.create_map(F.lit("*"), F.create_map(F.lit(""), F.array(F.lit("ast")), F.lit("*"), F.array(F.lit("abi"))))).when(k == 1, F.create_map(F.lit("*"), F.create_map(F.lit("*"), F.array(F.lit("abi"))))).otherwise(F.create_map(F.lit("*"), F.create_map(F.lit("*"), F.array(F.lit("ir")))))
    full = F.create_map(F.lit("*"), F.create_map(F.lit(""), F.array(F.lit("ast"), F.lit("*")), F.lit("*"), F.array(F.lit("abi"), F.lit("evm"))))
    a, b = F.struct(F.lit(1).alias("runs"), pick.alias("selection")), F.struct(F.when(F.col("id") % 2 == 0, 1).otherwise(2).alias("runs"), full.alias("selection"))
    rows = sources.select("id", "size", filters.can_use_cached(a, b, ["runs"]).alias("cached"), filters.contains_ast(pick).alias("ast"), pick.alias("selection"))
    counted = filters.selection_rows(rows).groupBy("id").agg(F.count(F.lit(1)).cast("int").alias("n_outputs"))
    wanted = F.array_compact(F.array(F.when(F.col("id") % 5 == 0, "generatedSources"), F.when(k == 2, "ir"), F.lit("abi")))
    return rows.withColumn("lacks", incremental.artifact_lacks_output(wanted, F.array(F.lit("abi")))).join(counted, "id").select("id", "cached", "ast", "n_outputs", "lacks")


@_query(
    """SELECT id, '--standard-json' || CASE WHEN size % 10 > 6 OR (size % 10 = 6 AND id % 15 >= 9) THEN ' --base-path root' ELSE '' END || CASE WHEN size % 10 > 8 OR (size % 10 = 8 AND id % 15 >= 8) THEN ' --include-path lib' ELSE '' END AS arguments,
      CASE id % 3 WHEN 0 THEN '0.8.' || CAST(size AS VARCHAR) || '+commit.e.Linux.gcc' WHEN 1 THEN '0.3.' || CAST(size AS VARCHAR) END AS version FROM sources""",
    sources=SOURCES,
)
def compiler_calls(spark, sources):
    """Arguments by release, and the version in what a program prints."""
    v = F.array(F.lit(0), F.col("size") % 10, (F.col("id") % 15).cast("int"))
    n = F.col("size").cast("string")
    printed = F.when(F.col("id") % 3 == 0, F.concat(F.lit("some line\nVersion: 0.8."), n, F.lit("+commit.e.Linux.g++\n\n"))).when(F.col("id") % 3 == 1, F.concat(F.lit("0.3."), n, F.lit("\n")))
    return sources.select("id", F.array_join(planner.command_line(v, F.lit("root"), ["lib"], []), " ").alias("arguments"), solidity.compiler_version(printed).alias("version"))


# Extraction


_VYPER = """SELECT p_partkey AS id, concat('m/C', CAST(p_partkey AS STRING), '.vy') AS path, concat(CASE WHEN p_size % 3 = 0 THEN '# @version ' WHEN p_size % 3 = 1 THEN '#pragma version ' ELSE '# none ' END, '>=0.3.', CAST(p_size AS STRING), chr(10), 'import a.C', CAST(p_partkey % 9 AS STRING), ' as X', chr(10),
  'from . import C', CAST(p_partkey % 13 AS STRING), chr(10), 'from ..lib import D', chr(10), 'x: int # import y', chr(10)) AS content, p_size AS size FROM {part}"""


@_query(
    """SELECT id, CASE WHEN size % 3 = 1 THEN '>=0.3.' || CAST(size AS VARCHAR) END AS version, '0:a.C' || CAST(id % 9 AS VARCHAR) || ',1:C' || CAST(id % 13 AS VARCHAR) || ',2:lib.D' AS imports, CASE WHEN EXISTS (SELECT 1 FROM files g WHERE g.id = f.id % 13) THEN 'm/C' || CAST(id % 13 AS VARCHAR) || '.vy' END AS resolved FROM files f""",
    files=_VYPER,
)
def vyper_sources(spark, files):
    """Versions and imports of Vyper sources, and where the relative ones lead."""
    rows = files.select("id", "path", solidity.vyper_version(F.col("content")).alias("version"), solidity.vyper_imports(F.col("content")).alias("i"))
    asked = rows.select("id", F.col("path").alias("file"), F.get("i", 1)["level"].alias("level"), F.get("i", 1)["path"].alias("path"))
    libraries = spark.createDataFrame([(0, "lib")], "ordinal int, path string")
    found = resolve.resolve_vyper(asked, files.select("path"), libraries).select("id", F.col("path").alias("resolved"))
    return rows.join(found, "id").select("id", "version", F.array_join(F.transform("i", lambda x: F.concat_ws(":", x["level"].cast("string"), x["path"])), ",").alias("imports"), "resolved")


@_query(
    """WITH s AS (SELECT id, brand, 'pragma solidity ' || regexp_extract(content, 'pragma solidity (.+?);', 1) || ';' AS whole, regexp_extract(content, 'pragma solidity (.+?);', 1) AS requirement, size FROM sources)
    SELECT id, whole, requirement, CASE WHEN size % 3 = 0 THEN 32 ELSE 0 END AS start, CASE WHEN size % 3 = 0 THEN 32 ELSE 0 END + length(whole) AS stop, id % 4 = 0 AS uses, CASE id % 3 WHEN 0 THEN 'new N(); string s = "T"; // T' WHEN 1 THEN 'N.f(xT, ''T''); /* T */ function T() {}' ELSE 'a.T(T1) is N {}' END AS renamed FROM s""",
    sources=SOURCES,
)
def captured_names(spark, sources):
    """Matches with their places, names that a text uses, and aliases written as names outside strings and comments."""
    c = solidity.captures(F.col("content"), solidity.PRAGMA)[0]
    text = F.when(F.col("id") % 3 == 0, 'new T(); string s = "T"; // T').when(F.col("id") % 3 == 1, "T.f(xT, 'T'); /* T */ function T() {}").otherwise("a.T(T1) is T {}")
    names = F.array(F.struct(F.lit("T").alias("alias"), F.lit("N").alias("target")))
    using = F.when(F.col("id") % 8 == 0, "contract X is A, Lib {").when(F.col("id") % 4 == 0, "using Lib for uint;").when(F.col("id") % 4 == 1, "LibX.f()").otherwise("xLib")
    return sources.select("id", c["whole"].alias("whole"), c["inner"].alias("requirement"), c["start"].alias("start"), c["end"].alias("stop"), solidity.references_name(using, F.lit("Lib")).alias("uses"), solidity.renamed(text, names).alias("renamed"))


# Bytecode, source maps and syntax trees


@_query(
    """SELECT id, id % 2 = 0 AS has_name, CASE WHEN id % 3 = 0 THEN '60aaf3' ELSE '60' || repeat('00', 20) || 'f3' END AS decoded, CASE WHEN id % 3 = 1 THEN NULL ELSE '60f3' END AS resolved, CASE id % 3 WHEN 0 THEN 'view' WHEN 1 THEN 'payable' ELSE 'pure' END AS mutability,
      CASE id % 4 WHEN 0 THEN 'constructor' WHEN 1 THEN 'fallback' WHEN 2 THEN 'function' ELSE 'receive' END AS kind, CASE WHEN id % 2 = 0 THEN 'constant' ELSE 'immutable' END AS variable, CASE WHEN size % 5 = 0 THEN NULL ELSE size END AS start, size + 1 AS length, CAST(id % 3 AS BIGINT) * 1073741824 + size AS packed FROM sources""",
    sources=SOURCES,
)
def bytecode_facts(spark, sources):
    """Placeholders, decoding, kinds of functions and variables, locations and packed jumps."""
    id_, size = F.col("id"), F.col("size")
    name = F.concat(F.col("path"), F.lit(":Lib"))
    held = F.concat(F.lit("60__"), F.when(id_ % 2 == 0, bytecode.name_placeholder(name)).otherwise(F.lit("other")), F.lit("__f3"))
    plain = F.when(id_ % 3 == 0, "0x60aaF3").otherwise("60__$" + "a" * 34 + "$__f3")
    loc = bytecode.source_location(F.concat_ws(":", F.when(size % 5 == 0, -1).otherwise(size).cast("string"), (size + 1).cast("string"), F.lit("0")))
    jump = sourcemap.packed(F.when(id_ % 3 == 0, "i").when(id_ % 3 == 1, "o").otherwise("-"), size.cast("long"))
    return sources.select(
        "id", bytecode.contains_placeholder(held, name, F.lit("0" * 34)).alias("has_name"), F.lower(F.hex(bytecode.without_placeholders(plain))).alias("decoded"), F.lower(F.hex(bytecode.decode(F.when(id_ % 3 == 1, "60__f3").otherwise("0x60f3")))).alias("resolved"),
        bytecode.state_mutability(F.when(id_ % 3 == 2, "pure"), id_ % 3 == 0, id_ % 3 == 1).alias("mutability"), bytecode.function_kind(F.when(id_ % 4 == 3, "receive"), id_ % 4 == 0, F.when(id_ % 4 == 1, "").otherwise("f")).alias("kind"),
        bytecode.variable_mutability(F.when(id_ % 2 == 1, "immutable"), F.lit(True)).alias("variable"), loc["start"].alias("start"), loc["length"].alias("length"), jump.alias("packed"),
    )


@_query(
    """SELECT id, '60' || CASE WHEN id % 2 = 0 THEN repeat('ab', 20) ELSE '__' || rpad(substr('a.sol:' || brand, 1, 36), 36, '_') || '__' END || '61' || CASE WHEN id % 3 = 0 THEN repeat('cd', 20) ELSE '__' || rpad('b.sol:B', 36, '_') || '__' END AS code, id % 6 = 0 AS linked,
      concat_ws(',', CASE WHEN id % 2 <> 0 THEN 'a.sol' END, CASE WHEN id % 3 <> 0 THEN 'b.sol' END) AS left_over, CASE WHEN id % 2 = 0 THEN 'x.sol,y.sol' ELSE 'y.sol' END AS merged FROM sources""",
    sources=SOURCES,
)
def linked_libraries(spark, sources):
    """Several libraries linked in turn, and what is left of the references; references of two codes as one."""
    code = F.concat(F.lit("60__"), bytecode.name_placeholder(F.concat(F.lit("a.sol:"), "brand")), F.lit("__61__"), bytecode.name_placeholder(F.lit("b.sol:B")), F.lit("__"))
    lib = lambda file, name, address: F.struct(F.lit(file).alias("file"), name.alias("name"), F.lit("0" * 34).alias("digest"), F.lit(address).alias("address"))
    libs = F.array_compact(F.array(F.when(F.col("id") % 2 == 0, lib("a.sol", F.col("brand"), "0x" + "AB" * 20)), lib("c.sol", F.lit("C"), "0x" + "00" * 20), F.when(F.col("id") % 3 == 0, lib("b.sol", F.lit("B"), "cd" * 20))))
    out = bytecode.link_all(code, F.create_map(F.lit("a.sol"), F.array(F.col("brand")), F.lit("b.sol"), F.array(F.lit("B"))), libs)
    two = bytecode.merged_references(F.when(F.col("id") % 2 == 0, F.create_map(F.lit("x.sol"), F.lit(1))).otherwise(F.create_map(F.lit("y.sol"), F.lit(2))), F.create_map(F.lit("y.sol"), F.lit(3)))
    return sources.select("id", out["code"].alias("code"), out["linked"].alias("linked"), F.array_join(F.array_sort(F.map_keys(out["references"])), ",").alias("left_over"), F.array_join(F.array_sort(F.map_keys(two)), ",").alias("merged"))


@_query(
    """WITH n AS (SELECT path, id, size, regexp_extract(ast, '"ContractDefinition","name":"([^"]*)"', 1) AS name FROM trees)
    SELECT path, name, 'f' AS member, id * 10 + 1 AS contract_id, '30:1' AS place, CASE WHEN size % 2 = 0 THEN name END AS library, CASE WHEN size % 2 = 0 THEN false END AS is_inlined, '// ' || path || chr(10) AS header, 9 AS cut_from, 29 AS cut_to, true AS has_contract FROM n""",
    trees=_TREE,
)
def syntax_tree_facts(spark, trees):
    """Members of contracts, references, libraries, and edits that come from nodes."""
    nodes = Written(ast.walk(trees), "nodes").df
    members = ast.contract_level_definitions(nodes).select("id", F.col("name").alias("member"), "contract_id")
    refs = ast.references(nodes).select(F.col("declaration").alias("id"), F.concat_ws(":", F.get("places", 0)["start"].cast("string"), F.get("places", 0)["length"].cast("string")).alias("place"))
    parsed = ast.parsed_from_ast(nodes).select("path", F.get("contract_names", 0).alias("name"), F.get("libraries", 0)["name"].alias("library"), F.get("libraries", 0)["is_inlined"].alias("is_inlined"))
    cuts = edits.removals(nodes, "FunctionDefinition").select("path", F.col("start").cast("int").alias("cut_from"), F.col("end").cast("int").alias("cut_to"))
    heads = edits.file_headers(trees).select("path", F.col("text").alias("header"))
    whole = trees.select("path", filters.contains_contract_definition(F.try_parse_json("ast")).alias("has_contract"))
    owner = nodes.where("node_type = 'FunctionDefinition'").select("path", "id")
    return parsed.join(owner, "path").join(members, "id").join(refs, "id").join(cuts, "path").join(heads, "path").join(whole, "path").select("path", "name", "member", "contract_id", "place", "library", "is_inlined", "header", "cut_from", "cut_to", "has_contract")


# Filters, graphs and imports


@_query(
    """SELECT s.path, ends_with(s.path, '.t.sol') OR id % 5 = 0 AS is_test, (size % 2 = 0 AND id % 3 = 0) OR id % 7 = 1 AS selected, id % 4 = 0 AS retained, CASE WHEN starts_with(path, 'src/d1/') THEN 1 WHEN starts_with(path, 'src/d2/') THEN 3 ELSE 2 END AS severity, id % 6 = 0 AS matching FROM sources s""",
    sources=SOURCES,
)
def file_predicates(spark, sources):
    """Tests, files that keep their outputs, retained files, and severities in order."""
    p, id_ = F.col("path"), F.col("id")
    jobs = sources.select(F.lit(1).alias("job_id"), "path", (F.col("size") % 2 == 0).alias("dirty"), (id_ % 3 == 0).alias("matches"))
    chosen = filters.sparse_outputs(jobs, sources.where("id % 7 = 1").select(F.lit(1).alias("job_id"), "path"), False).select("path", "selected")
    kept = filters.retain_files(sources.select("path"), sources.where("id % 4 = 0").select(F.upper("path").alias("path"))).select("path", F.lit(True).alias("retained"))
    match = filters.matching_files(sources, id_ % 6 == 0).select("path", F.lit(True).alias("matching"))
    names = F.when(id_ % 5 == 0, F.array(F.lit("IS_TEST"))).otherwise(F.array(F.lit("f")))
    severity = F.when(F.startswith(p, F.lit("src/d1/")), "Error").when(F.startswith(p, F.lit("src/d2/")), "info").otherwise("WARNING")
    rows = sources.select("path", filters.is_test(p, names).alias("is_test"), filters.severity_rank(severity).cast("int").alias("severity"))
    rows = rows.join(chosen, "path").join(kept, "path", "left").join(match, "path", "left")
    return rows.select("path", "is_test", "selected", F.coalesce("retained", F.lit(False)).alias("retained"), "severity", F.coalesce("matching", F.lit(False)).alias("matching"))


@_query(
    f"RECURSIVE WITH {_CLOSURE}, k AS (SELECT path, id % 3 = 0 AS is_source, size % 9 = 0 AS changed, size % 18 = 0 AS iface FROM sources)"
    " SELECT path FROM k WHERE changed UNION SELECT a.path FROM reach r JOIN k a ON r.root = a.path JOIN k b ON r.node = b.path WHERE r.root <> r.node AND b.changed AND ((a.is_source AND b.is_source) OR NOT b.is_source OR b.iface)",
    edges=EDGES,
    sources=SOURCES,
)
def dirty_by_interface(spark, edges, sources):
    """Dirty files where tests see sources by their interface alone."""
    s = sources.select("path", F.when(F.col("id") % 3 == 0, "source").when(F.col("id") % 3 == 1, "test").otherwise("mock").alias("kind"), (F.col("size") % 9 == 0).alias("changed"), (F.col("size") % 18 == 0).alias("interface_changed"))
    return graph.dirty_by_interface(s, edges)


@_query(
    f"RECURSIVE WITH {_CLOSURE}, every AS (SELECT root, node FROM reach UNION SELECT path, path FROM sources) SELECT root AS target, CASE WHEN split_part(node, '/', 2) = 'd1' THEN split_part(node, '/', 3) ELSE '../' || substr(node, 5) END AS path, length(content) AS n_chars FROM every JOIN sources s ON node = s.path WHERE root IN (SELECT path FROM sources WHERE size % 10 = 1)",
    edges=EDGES,
    sources=SOURCES,
)
def standard_inputs(spark, edges, sources):
    """Targets with all they import, relative to a folder."""
    return graph.standard_input(edges, sources.where("size % 10 = 1").select("path"), sources, "src/d1").select("target", "path", F.length("content").alias("n_chars"))


@_query(
    """WITH i AS (SELECT path AS file, './C' || CAST(id % 50 AS VARCHAR) AS import, id % 4 AS k FROM sources), f AS (SELECT file, import, k FROM i WHERE k = 0)
    SELECT import, file, 'Solidity' AS language FROM f UNION ALL SELECT 'vyper:' || import, file, 'Vyper' FROM i WHERE k = 1 UNION ALL SELECT import, file, 'Yul' FROM i WHERE k IN (2, 3)""",
    sources=SOURCES,
)
def unresolved_imports(spark, sources):
    """Imports that lead nowhere, after each language's last step."""
    k = F.col("id") % 4
    rows = sources.select(F.concat(F.lit("./C"), (F.col("id") % 50).cast("string")).alias("import"), F.col("path").alias("file"), F.when(k == 0, "Solidity").when(k == 1, "Vyper").otherwise("Yul").alias("language"), F.lit(None).cast("string").alias("path"))
    done = graph.finalize_imports(rows, {"Vyper": lambda df: df.withColumn("import", F.concat(F.lit("vyper:"), "import"))})
    return graph.unresolved(done).join(rows.select("file", "language").distinct(), "file").select("import", "file", "language")


@_query(
    """WITH w AS (SELECT id, path, CASE id % 3 WHEN 0 THEN path WHEN 1 THEN regexp_replace(path, '/C', '/c') ELSE path || 'x' END AS wanted FROM sources)
    SELECT wanted AS path, CASE id % 3 WHEN 0 THEN NULL WHEN 1 THEN 'wrong case: ' || path ELSE 'missing' END AS error FROM w""",
    sources=SOURCES,
)
def read_failures(spark, sources):
    """Why files can't be read: another case of the name, or missing."""
    k = F.col("id") % 3
    wanted = sources.select(F.when(k == 0, F.col("path")).when(k == 1, F.replace("path", F.lit("/C"), F.lit("/c"))).otherwise(F.concat("path", F.lit("x"))).alias("path"))
    return scan.read_errors(wanted, sources.select("path"))


@_query(
    """SELECT DISTINCT 'p' || CAST(id % 40 AS VARCHAR) || '/' AS name, 'lib/p' || CAST(id % 40 AS VARCHAR) || CASE id % 40 % 4 WHEN 0 THEN '/src/' WHEN 1 THEN '/contracts/' WHEN 2 THEN '/src/' ELSE '/' END AS path FROM sources""",
    sources=SOURCES,
)
def found_remappings(spark, sources):
    """Remappings from a listing of a library folder."""
    p, k = F.concat(F.lit("lib/p"), (F.col("id") % 40).cast("string")), F.col("id") % 40 % 4
    files = F.when(k == 0, F.array(F.concat(p, F.lit("/src/X.sol")), F.concat(p, F.lit("/test/Y.sol")))).when(k == 1, F.array(F.concat(p, F.lit("/contracts/X.sol")))).when(k == 2, F.array(F.concat(p, F.lit("/contracts/X.sol")), F.concat(p, F.lit("/src/a/X.sol")))).otherwise(F.array(F.concat(p, F.lit("/X.sol")), F.concat(p, F.lit("/README.md"))))
    return remappings.find_remappings(sources.select(F.explode(files).alias("path")), "lib")


# The cache


@_query(
    """WITH e AS (SELECT path, id, size % 2 = 0 AS seen FROM sources)
    SELECT path, id % 3 <> 0 AS there, CASE WHEN id % 5 = 0 THEN true ELSE seen END AS seen, md5(content) AS content_hash, coalesce((SELECT count(DISTINCT dst) FROM edges WHERE src = s.path), 0) AS n_imports FROM sources s JOIN e USING (path, id)""",
    sources=SOURCES,
    edges=EDGES,
)
def cache_entries(spark, sources, edges):
    """Entries with hashes and imports, those whose file is there, and those that a compiler has seen."""
    rows = incremental.cache_entry_rows(sources.select("path", "content", F.lit(0).cast("long").alias("mtime_ms"), F.lit("x").alias("version_text")), edges)
    rows = rows.join(sources.select("path", (F.col("size") % 2 == 0).alias("s")), "path").withColumn("seen", F.col("s"))
    rows = incremental.mark_seen(rows, sources.where("id % 5 = 0").select("path"))
    there = incremental.existing_entries(rows, sources.where("id % 3 <> 0").select("path")).select("path", F.lit(True).alias("there"))
    return rows.join(there, "path", "left").select("path", F.coalesce("there", F.lit(False)).alias("there"), "seen", "content_hash", F.size("imports").cast("long").alias("n_imports"))


@_query(
    """WITH profiles AS (SELECT path, name, version, CASE WHEN ordinal % 3 = 0 THEN 'old' ELSE 'default' END AS profile, build_id, artifact_path FROM artifacts), kept AS (SELECT * FROM profiles WHERE profile = 'default' AND CAST(build_id AS INT) % 2 = 0)
    SELECT path, name, version, artifact_path, path IN (SELECT path FROM profiles WHERE profile = 'default' AND CAST(build_id AS INT) % 2 = 0) AS entry, CASE WHEN profile = 'default' AND CAST(build_id AS INT) % 2 = 0 THEN artifact_path END AS existing FROM profiles""",
    artifacts=KEYED,
)
def cache_upkeep(spark, artifacts):
    """Artifacts of known builds and of profiles that stay, the entries that still have one, and lookups in them."""
    rows = artifacts.withColumn("profile", F.when(F.col("ordinal") % 3 == 0, "old").otherwise("default")).drop("ordinal")
    known = incremental.with_known_builds(rows, artifacts.where("cast(build_id as int) % 2 = 0").select("build_id"))
    judged = spark.createDataFrame([("default", True), ("old", False)], "profile string, keep boolean")
    kept, entries = incremental.drop_profiles(known, rows.select("path").distinct(), judged)
    had = rows.select("path").distinct().join(known.select("path").distinct(), "path", "left_semi")
    entries = entries.join(had, "path", "left_semi").withColumn("entry", F.lit(True))
    found = incremental.existing_artifacts(rows.select(*incremental.KEY), kept).withColumnRenamed("artifact_path", "existing")
    return rows.join(found, incremental.KEY).join(entries, "path", "left").select("path", "name", "version", "artifact_path", F.coalesce("entry", F.lit(False)).alias("entry"), "existing")


# Scans, sinks, planning


def _folder(spark, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/buildlens/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


@_query("SELECT path, content, octet_length(content::BLOB) AS bytes, CASE WHEN id % 2 = 0 THEN 'src' ELSE 'test' END AS kind, regexp_replace(path, '/[^/]*$', '') AS folder FROM sources", sources=SOURCES)
def written_and_read(spark, sources):
    """Sources written as files of two folders and read again, with their listing and folders."""
    root = _folder(spark, "project")
    bare = root if "://" in root else "file://" + root
    rows = sources.select(F.concat(F.when(F.col("id") % 2 == 0, "src/").otherwise("test/"), "path").alias("path"), "content")
    written = Written(sinks.write_files(rows, bare), "written").df
    read = scan.project_inputs(spark, {"src": f"{bare}/src", "test": f"{bare}/test"})
    read = Written(read.withColumn("path", F.regexp_replace("path", "^" + bare + "/(src|test)/", "")), "read").df
    listing = scan.source_listing(spark, bare).select(F.regexp_replace("path", "^(src|test)/", "").alias("path"), "length")
    folders = scan.source_dirs(read).select(F.col("path").alias("folder"))
    sizes = written.select(F.regexp_replace("path", "^(src|test)/", "").alias("path"), F.col("bytes"))
    out = read.join(listing, "path").join(sizes, "path").where("length = bytes").withColumn("folder", paths.parent(F.col("path"))).join(folders, "folder")
    return out.select("path", "content", F.col("bytes").cast("long").alias("bytes"), "kind", "folder")


@_query("SELECT path, name, version, profile, 'root/' || artifact_path AS artifact_path, build_id, md5(path) AS content_hash FROM artifacts", artifacts=KEYED)
def cache_file(spark, artifacts):
    """A cache written as one file and read again, with paths joined to a root; then as tables."""
    made = artifacts.select("path").distinct().select("path", F.md5("path").alias("content_hash"), F.col("path").alias("source_name"), F.lit(True).alias("seen"))
    root = _folder(spark, "cache")
    bare = root if "://" in root else "file://" + root
    sinks.write_cache_file(made, artifacts, spark.createDataFrame([("1",), ("2",)], "build_id string"), "", f"{bare}/cache.json")
    entries, found, builds = scan.read_cache(spark, f"{bare}/cache.json", "root")
    sinks.write_cache(entries, found, builds, f"{bare}/tables")
    again, held = spark.read.parquet(f"{bare}/tables/artifacts"), spark.read.parquet(f"{bare}/tables/entries")
    strip = lambda df: df.withColumn("path", F.regexp_replace("path", "^root/", ""))
    return strip(again).join(strip(held).select("path", "content_hash"), "path").select("path", "name", "version", "profile", "artifact_path", "build_id", "content_hash")


@_query("SELECT DISTINCT 'b' || build_id || '.json' AS path, '{\"build_id\":\"b' || build_id || '\",\"n\":1}' AS content FROM artifacts UNION ALL SELECT regexp_replace(artifact_path, '\\.json$', '') || '.' || kind AS path, kind || path AS content FROM artifacts, (VALUES ('ir'), ('abi')) k(kind) WHERE kind = 'ir' OR ordinal % 2 = 0 UNION ALL SELECT artifact_path, '{\"name\":\"' || name || '\"}' FROM artifacts", artifacts=KEYED)
def sink_files(spark, artifacts):
    """Contents of build information, of extra files and of artifacts."""
    builds = sinks.build_info_json(artifacts.select(F.concat(F.lit("b"), "build_id").alias("build_id")).distinct().withColumn("n", F.lit(1)))
    rows = artifacts.select(F.col("artifact_path").alias("file"), "name", F.concat(F.lit("ir"), "path").alias("ir"), F.when(F.col("ordinal") % 2 == 0, F.concat(F.lit("abi"), "path")).alias("abi"))
    return builds.unionByName(sinks.extra_files(rows, {"ir": "ir", "abi": "abi"})).unionByName(sinks.artifact_json(rows, ["name"]))


def _stub_stream(version: str, pieces: Iterator[str]) -> Iterator[str]:
    """Stands for a compiler: a contract and a warning for each file. What comes after the warnings is kept in files."""
    with tempfile.TemporaryFile("w+", encoding="utf-8", newline="") as contracts, tempfile.TemporaryFile("w+", encoding="utf-8", newline="") as sources:
        yield '{"errors":['
        comma = ""
        for p, s in ((key, json.loads(text)) for name, _, key, text in json_parts.members(pieces) if name == "sources"):
            yield f'{comma}{{"severity":"warning","errorCode":"1878","message":{p},"formattedMessage":{p},"sourceLocation":{{"file":{p},"start":0,"end":1}}}}'
            contracts.write(f'{comma}{p}:{{"C{len(s["content"])}":{{"abi":[],"evm":{{"bytecode":{{"object":"60{version[-1]}"}}}}}}}}')
            sources.write(f'{comma}{p}:{{"id":{len(json.loads(p))},"ast":{{"nodeType":"SourceUnit"}}}}')
            comma = ","
        for begin, held in (('],"contracts":{', contracts), ('},"sources":{', sources)):
            yield begin
            held.seek(0)
            yield from iter(lambda f=held: f.read(1 << 16), "")
        yield "}}"


def _stub(version: str, text: str) -> str:
    """The same for a whole text."""
    return "".join(_stub_stream(version, iter([text])))


@_query(
    "SELECT path, CASE WHEN size % 2 = 0 THEN '0.8.0' ELSE '0.7.6' END AS version, 'C' || CAST(length(content) AS VARCHAR) AS name, '60' || CASE WHEN size % 2 = 0 THEN '0' ELSE '6' END AS bytecode, 1878 AS error_code, length(path) AS source_id FROM sources",
    sources=SOURCES,
)
def compiled_contracts(spark, sources):
    """Jobs run by a function of their language, and their outputs as tables."""
    jobs = sources.select("path", F.lit("Solidity").alias("language"), F.when(F.col("size") % 2 == 0, "0.8.0").otherwise("0.7.6").alias("version"), F.lit("default").alias("profile"))
    done = Written(planner.run_job_streams(jobs, sources, {"Solidity": _stub_stream}, parallel=2), "outputs").df
    diagnostics, contracts, out = planner.output_tables(done)
    rows = contracts.select("path", "version", "name", "bytecode").join(diagnostics.select(F.col("file").alias("path"), F.col("error_code").cast("int").alias("error_code")), "path")
    return rows.join(out.select("path", F.col("source_id").cast("int").alias("source_id")), "path")


@_query(
    """WITH one AS (SELECT severity, error_code, file, min(id) AS id FROM diagnostics GROUP BY ALL) SELECT id, CASE severity WHEN 'warning' THEN 2 ELSE 3 END AS rank, CASE severity WHEN 'warning' THEN '0.8.2' ELSE '0.8.24' END AS highest FROM one""",
    diagnostics=DIAGNOSTICS,
)
def ranked_diagnostics(spark, diagnostics):
    """Severities in order, and versions out of folder names."""
    one = diagnostics.groupBy("severity", "error_code", "file").agg(F.min("id").alias("id"))
    names = spark.createDataFrame([("0.8.2",), ("0.8.24",), ("x",), ("0.8.24-nightly",)], "name string")
    v = scan.installed_versions(names).agg(F.array_sort(F.collect_list("v")).alias("all"))
    text = F.array_join(F.when(F.col("severity") == "warning", F.get(v.scalar(), 0)).otherwise(F.element_at(v.scalar(), -1)).cast("array<string>"), ".")
    return one.select("id", filters.severity_rank(F.col("severity")).cast("int").alias("rank"), text.alias("highest"))


@_query("SELECT path, name, version, profile, artifact_path, build_id, md5(path) AS content_hash, length(path) AS mtime_ms, (SELECT count(DISTINCT build_id) FROM artifacts) AS n_builds FROM artifacts", artifacts=KEYED)
def cache_as_one_file(spark, artifacts):
    """The cache's tables written as one JSON file, and read again."""
    entries = artifacts.select("path", F.md5("path").alias("content_hash"), F.length("path").cast("long").alias("mtime_ms"), F.lit(True).alias("seen")).distinct()
    root = _folder(spark, "one-cache")
    bare = root if "://" in root else "file://" + root
    sinks.write_cache_file(entries, artifacts, artifacts.select("build_id"), "one", f"{bare}/cache.json")
    held, found, builds = scan.read_cache(spark, f"{bare}/cache.json")
    n = builds.agg(F.count(F.lit(1))).scalar()
    return found.join(held.select("path", "content_hash", F.col("mtime_ms").cast("int").alias("mtime_ms")), "path").select("path", "name", "version", "profile", "artifact_path", "build_id", "content_hash", "mtime_ms", n.alias("n_builds"))


@_query("SELECT path AS build_id, CASE WHEN size % 4 < 2 THEN size END AS n, CASE size % 4 WHEN 2 THEN 'unreadable' WHEN 3 THEN 'missing' END AS error FROM (SELECT DISTINCT replace(path, '/', '_') AS path, size FROM sources)", sources=SOURCES)
def builds_by_id(spark, sources):
    """Build information by id: read, unreadable or missing."""
    rows = sources.select(F.replace(F.col("path"), F.lit("/"), F.lit("_")).alias("build_id"), "size")
    text = F.when(F.col("size") % 4 < 2, F.concat(F.lit('{"n":'), "size", F.lit("}"))).otherwise("{")
    listing = rows.where("size % 4 < 3").select(F.concat(F.lit("out/build-info/"), "build_id", F.lit(".json")).alias("path"), text.alias("content"))
    return scan.read_builds(listing, rows.select("build_id"), "n int").select("build_id", "build.n", "error")


_HEADS = """SELECT p_partkey AS id, concat('H', CAST(p_partkey AS STRING)) AS path, p_size AS size, concat('{"nodeType":"SourceUnit","id":1,"src":"0:9:0","nodes":[',
  CASE WHEN p_size % 3 = 0 THEN '' ELSE concat('{"nodeType":"PragmaDirective","id":2,"src":"0:1:0","literals":["solidity",">=","0.', CAST(p_size AS STRING), '",".0","<","0.9"]},') END,
  CASE WHEN p_size % 2 = 0 THEN '{"nodeType":"PragmaDirective","id":3,"src":"1:1:0","literals":["experimental","X"]},' ELSE '' END,
  '{"nodeType":"ImportDirective","id":4,"src":"2:1:0","file":"./f.sol"', CASE WHEN p_size % 5 = 0 THEN concat(',"unitAlias":"U', CAST(p_partkey AS STRING), '","symbolAliases":[]')
  ELSE concat(',"unitAlias":"","symbolAliases":[{"foreign":{"name":"F', CAST(p_partkey AS STRING), '"},"local":', CASE WHEN p_size % 5 = 1 THEN 'null' ELSE '"L"' END, '}]') END, '}]}') AS ast FROM {part}"""


@_query(
    """SELECT path, CASE WHEN size % 3 <> 0 THEN '>=0.' || CAST(size AS VARCHAR) || '.0 <0.9' END AS version_text, CASE WHEN size % 2 = 0 THEN 'X' END AS experimental,
    CASE WHEN size % 5 > 1 THEN 'F' || CAST(id AS VARCHAR) END AS target, CASE size % 5 WHEN 0 THEN 'U' || CAST(id AS VARCHAR) WHEN 1 THEN 'F' || CAST(id AS VARCHAR) ELSE 'L' END AS alias FROM trees""",
    trees=_HEADS,
)
def syntax_tree_heads(spark, trees):
    """Pragmas and import aliases from syntax trees."""
    parsed = ast.parsed_from_ast(Written(ast.walk(trees), "nodes").df)
    return parsed.select("path", "version_text", "experimental", F.explode(F.flatten("aliases")).alias("a")).select("path", "version_text", "experimental", "a.*")


NAMES = sorted(set(QUERIES) - _BEFORE)

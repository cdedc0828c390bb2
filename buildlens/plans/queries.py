"""Registered queries: the operators on project tables derived from the driver's tables, whole, in either engine.

The derivations are written in SQL that Spark and DuckDB read alike. Sources come from part, imports from its keys,
diagnostics from events, source maps from lineitem, cached artifacts from orders.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from buildlens.functions import bytecode, paths, solidity, versions
from buildlens.operators import ast, edits, filters, graph, incremental, outputs, resolve, solve, sourcemap
from buildlens.plans.planner import parsed_sources
from buildlens.storage import Written, shared_dir

PATH = "concat('src/d', CAST({k} % 17 AS STRING), '/C', CAST({k} AS STRING), CASE WHEN {k} % 7 = 0 THEN '.t.sol' WHEN {k} % 11 = 0 THEN '.yul' ELSE '.sol' END)"
_P = PATH.format(k="p_partkey")
#: path, content, size; every file imports ./C<n>.sol by pattern and has a pragma of one of five forms.
SOURCES = f"""SELECT p_partkey AS id, {_P} AS path, p_size AS size, p_brand AS brand, concat(
  CASE WHEN p_size % 3 = 0 THEN concat('// SPDX-License-Identifier: MIT', chr(10)) ELSE '' END,
  'pragma solidity ', CASE p_size % 5 WHEN 0 THEN '^0.8.0' WHEN 1 THEN '>=0.7.0 <0.9.0' WHEN 2 THEN '0.8.19' WHEN 3 THEN '~0.8.4' ELSE '^0.7.5' END, ';', chr(10),
  'import "./C', CAST(p_partkey % 13 AS STRING), '.sol";', chr(10),
  'import {{Token as T}} from "lib/token/Token.sol";', chr(10),
  'contract ', replace(p_brand, '#', '_'), ' {{}}', chr(10),
  'library L', CAST(p_partkey AS STRING), ' {{ function f() ', CASE WHEN p_size % 2 = 0 THEN 'public' ELSE 'internal' END, ' {{}} }}', chr(10)) AS content FROM {{part}}"""
#: A tree of imports with some cycles.
EDGES = f"""SELECT {_P} AS src, {PATH.format(k="CAST(floor(p_partkey / 3) AS BIGINT)")} AS dst FROM {{part}} WHERE p_partkey >= 3
  UNION ALL SELECT {PATH.format(k="CAST(floor(p_partkey / 3) AS BIGINT)")} AS src, {_P} AS dst FROM {{part}} WHERE p_partkey >= 3 AND p_partkey % 50 = 0"""
DIAGNOSTICS = """SELECT event_id AS id, CASE event_type WHEN 'click' THEN 'warning' WHEN 'view' THEN 'info' WHEN 'purchase' THEN 'warning' ELSE 'warning' END AS severity,
  CASE WHEN event_id % 9 = 0 THEN NULL WHEN event_id % 4 = 0 THEN CAST(1878 AS BIGINT) WHEN event_id % 4 = 1 THEN CAST(5574 AS BIGINT) ELSE CAST(2018 + event_id % 3 AS BIGINT) END AS error_code,
  concat(CASE WHEN user_id % 3 = 0 THEN 'lib/' WHEN user_id % 3 = 1 THEN 'src/' ELSE 'library/' END, 'F', CAST(user_id % 20 AS STRING), CASE WHEN user_id % 4 = 0 THEN '.t.sol' ELSE '.sol' END) AS file, user_id % 50 AS job FROM {events}"""
ARTIFACTS = """SELECT {path} AS path, concat('N', CAST(o_orderkey % 5 AS STRING)) AS name, concat('0.8.', CAST(o_orderkey % 3 AS STRING)) AS version, 'default' AS profile,
  concat('out/', CAST(o_orderkey AS STRING), '.json') AS artifact_path, CAST(o_orderkey % 101 AS STRING) AS build_id, o_orderkey AS ordinal FROM {orders}""".replace("{path}", PATH.format(k="o_custkey"))


_TABLES = ("part", "events", "orders", "lineitem", "pages")


def _derive(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    for t in _TABLES:
        if "{" + t + "}" in sql:
            view = f"buildlens_{t}_{uuid.uuid4().hex[:8]}"
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createTempView(view)
            sql = sql.replace("{" + t + "}", view)
    return spark.sql(sql)


def _duck(sql: str) -> str:
    for t in _TABLES:
        sql = sql.replace("{" + t + "}", t)
    return sql


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(oracle: str | None = None, **derived: str):
    """Registers a query; its oracle may name the derived tables."""

    def put(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(spark, *[_derive(spark, sf_dir, sql) for sql in derived.values()])

        QUERIES[f.__name__] = run
        if oracle:
            recursive = "RECURSIVE " if "RECURSIVE" in oracle else ""
            given = ", ".join(f"{n} AS ({_duck(sql)})" for n, sql in derived.items())
            body = oracle.replace("RECURSIVE", "").strip()
            ORACLE_SQL[f.__name__] = f"WITH {recursive}{given}{', ' + body[5:] if body.startswith('WITH ') else ' ' + body}"
        return f

    return put


@_query(
    r"""SELECT path, nullif(regexp_extract(content, 'pragma\s+solidity\s+(.+?);', 1), '') AS version_text,
      nullif(regexp_extract(split_part(content, chr(10), 1), '///?\s*SPDX-License-Identifier:\s*(.+)', 1), '') AS license,
      2 AS n_imports, regexp_extract(content, 'import "(.*)";', 1) AS first_import, 'lib/token/Token.sol' AS second_import, 'Token' AS target, 'T' AS alias,
      array_to_string(regexp_extract_all(content, '\b(?:contract|library|abstract\s+contract|interface)\s+([\w$]+)', 1), ',') AS contract_names,
      NOT contains(content, 'public') AS is_inlined, ends_with(path, '.yul') AS is_yul FROM sources""",
    sources=SOURCES,
)
def source_extraction(spark, sources):
    """Versions, licences, imports with aliases, contract names and libraries of every source."""
    p = parsed_sources(sources)
    i, lib = F.col("imports"), F.col("libraries")
    alias = i[1]["aliases"][0]
    return p.select("path", "version_text", "license", F.size(i).alias("n_imports"), i[0]["path"].alias("first_import"), i[1]["path"].alias("second_import"), alias["target"].alias("target"), alias["alias"].alias("alias"), F.array_join("contract_names", ",").alias("contract_names"), lib[0]["is_inlined"].alias("is_inlined"), "is_yul")


@_query(
    """WITH names AS (SELECT DISTINCT replace(brand, '#', '_') AS name, path FROM sources)
    SELECT name, count(*) AS n_paths, min(path) AS first_path, CASE WHEN count(*) = 1 THEN min(path) END AS path, CASE WHEN count(*) > 1 THEN 'ambiguous' END AS error FROM names GROUP BY name""",
    sources=SOURCES,
)
def contract_lookup(spark, sources):
    """Which files define each contract, and which names are ambiguous (libraries left out)."""
    parsed = sources.select("path", F.filter(solidity.contract_names(F.col("content")), lambda n: ~F.regexp_like(n, F.lit(r"^L\d+$"))).alias("contract_names"))
    both = outputs.contract_paths(parsed).join(outputs.unique_contract_path(parsed), "name")
    return both.select("name", F.size("paths").cast("long").alias("n_paths"), F.col("paths")[0].alias("first_path"), "path", "error")


_INSTALLED = [(0, 7, 4), (0, 7, 5), (0, 7, 6), (0, 8, 0), (0, 8, 4), (0, 8, 19), (0, 8, 24), (0, 9, 0)]


@_query(
    """WITH v(a, b, c) AS (VALUES """ + ", ".join(map(str, _INSTALLED)) + """), r AS (SELECT path, size % 5 AS k FROM sources)
    SELECT path, count(*) AS n, max(b * 100 + c) AS best FROM r, v WHERE a = 0 AND CASE k WHEN 0 THEN b = 8 WHEN 1 THEN b IN (7, 8) WHEN 2 THEN b = 8 AND c = 19 WHEN 3 THEN b = 8 AND c >= 4 ELSE b = 7 AND c >= 5 END GROUP BY path""",
    sources=SOURCES,
)
def version_candidates(spark, sources):
    """Versions that each file's own pragma allows, and the best of them."""
    v = spark.createDataFrame([(list(x),) for x in _INSTALLED], "v array<int>")
    reqs = solve.parsed_requirements(sources.select("path", solidity.version_text(F.col("content")).alias("version_text")))
    found = solve.file_candidates(reqs, solve.available_versions(v))
    best = solve.best_candidate(F.transform("candidates", lambda c: F.struct(c["v"].alias("v"), c["installed"].alias("installed"))))
    return found.where(F.size("candidates") > 0).select("path", F.size("candidates").cast("long").alias("n"), (best[1] * 100 + best[2]).alias("best"))


_REMAPPINGS = [(0, None, "lib/token/", "lib/token-v2/src/"), (1, "src/d3", "./C1", "src/d0/C17"), (2, None, "lib/", "dep/"), (3, None, "lib/token/", "never/")]


@_query(
    """WITH rules(ordinal, context, name, target) AS (VALUES (0, NULL, 'C', 'lib/C-v2'), (1, 'src/d3', 'A', 'ctx'), (2, NULL, 'A', 'any'), (3, NULL, 'A/x', 'late')),
    imports AS (SELECT path, regexp_replace(path, '/[^/]*$', '') AS cwd, concat(CASE id % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'A/x' ELSE 'Ab' END, '/f', CAST(id AS STRING), '.sol') AS import FROM sources),
    fits AS (SELECT path, import, name, target, row_number() OVER (PARTITION BY path ORDER BY ordinal) AS n FROM imports JOIN rules ON starts_with(import, name || '/') AND (context IS NULL OR cwd = context OR starts_with(cwd, context || '/')))
    SELECT path, target || substr(import, length(name) + 1) AS resolved FROM fits WHERE n = 1""",
    sources=SOURCES,
)
def remapped_imports(spark, sources):
    """The first remapping, in order, whose context and name fit, by path components."""
    i = F.concat(F.when(F.col("id") % 3 == 0, "A").when(F.col("id") % 3 == 1, "A/x").otherwise("Ab"), F.lit("/f"), F.col("id").cast("string"), F.lit(".sol"))
    imports = sources.select(F.col("path").alias("id"), paths.parent(F.col("path")).alias("cwd"), i.alias("import"))
    rules = spark.createDataFrame([(0, None, "C", "lib/C-v2"), (1, "src/d3", "A", "ctx"), (2, None, "A", "any"), (3, None, "A/x", "late")], "ordinal int, context string, name string, path string")
    return resolve.remapped(imports, rules, sources.select("path").limit(0)).select(F.col("id").alias("path"), F.col("path").alias("resolved"))


@_query(
    """WITH wanted AS (SELECT path, regexp_replace(path, '/[^/]*$', '') || '/C' || CAST(id % 13 AS STRING) || '.sol' AS relative, 'src/d1/C' || CAST(id % 40 AS STRING) || '.sol' AS direct FROM sources)
    SELECT w.path, coalesce(a.path, b.path) AS resolved, CASE WHEN a.path IS NOT NULL THEN 'relative' WHEN b.path IS NOT NULL THEN 'fallback' END AS how
    FROM (SELECT path, CASE WHEN length(path) % 2 = 0 THEN relative END AS relative, CASE WHEN length(path) % 2 = 1 THEN direct END AS direct FROM wanted) w LEFT JOIN sources a ON a.path = w.relative LEFT JOIN sources b ON b.path = w.direct""",
    sources=SOURCES,
)
def import_resolution(spark, sources):
    """Relative imports and such from a fallback directory, with what can't be resolved."""
    rel = F.concat(F.lit("./x/../C"), (F.col("id") % 13).cast("string"), F.lit(".sol"))
    direct = F.concat(F.lit("d1/C"), (F.col("id") % 40).cast("string"), F.lit(".sol"))
    imports = sources.select(F.col("path").alias("id"), paths.parent(F.col("path")).alias("cwd"), F.when(F.length("path") % 2 == 0, rel).otherwise(direct).alias("import"))
    rules = spark.createDataFrame([], "ordinal int, context string, name string, path string")
    libraries = spark.createDataFrame([(0, "lib")], "ordinal int, path string")
    found = resolve.resolve_imports(imports, rules, libraries, sources.select("path"), ["src"])
    return found.select(F.col("id").alias("path"), F.col("path").alias("resolved"), "how")


_CLOSURE = "reach AS (SELECT DISTINCT src AS root, dst AS node FROM edges UNION SELECT root, dst FROM reach JOIN edges ON node = src)"


@_query(f"RECURSIVE WITH {_CLOSURE} SELECT root, count(*) AS n_imports, max(node) AS last FROM reach GROUP BY root", edges=EDGES)
def transitive_imports(spark, edges):
    """How many files each file imports at any distance (itself on a cycle)."""
    reach = graph.transitive_imports(edges, edges.select(F.col("src").alias("path")))
    return reach.groupBy("root").agg(F.count(F.lit(1)).alias("n_imports"), F.max("node").alias("last"))


@_query("RECURSIVE WITH back AS (SELECT path FROM sources WHERE size = 7 UNION SELECT src FROM back JOIN edges ON path = dst) SELECT path FROM back", edges=EDGES, sources=SOURCES)
def dirty_files(spark, edges, sources):
    """Changed files and all that import them."""
    return graph.dirty_files(edges, sources.where("size = 7").select("path"))


@_query(
    f"RECURSIVE WITH {_CLOSURE}, own AS (SELECT DISTINCT src AS f FROM edges UNION SELECT dst FROM edges UNION SELECT path FROM sources), every AS (SELECT root, node FROM reach UNION SELECT f, f FROM own)"
    """, sizes AS (SELECT root AS node, count(*) AS n FROM every GROUP BY root), targets AS (SELECT path FROM sources)
    SELECT root AS target, node AS path, row_number() OVER (PARTITION BY root ORDER BY node = root, n, regexp_extract(node, '([^/]*)$', 1), node) - 1 AS place FROM every JOIN sizes USING (node) JOIN targets ON root = path""",
    edges=EDGES,
    sources=SOURCES,
)
def ordered_dependencies(spark, edges, sources):
    """Dependencies of every file in the order for flattening."""
    return graph.ordered_dependencies(edges, sources.select("path")).withColumn("place", F.col("place").cast("long"))


@_query("SELECT dst AS path, src AS importer FROM edges GROUP BY ALL", edges=EDGES)
def direct_importers(spark, edges):
    return graph.importers(edges, edges.select(F.col("dst").alias("path")))


@_query(
    f"RECURSIVE WITH {_CLOSURE}, ins AS (SELECT path, CASE WHEN size % 2 = 0 THEN '0.8.0' ELSE '0.7.6' END AS version FROM sources), every AS (SELECT root, node, false AS own FROM reach UNION ALL SELECT path, path, true FROM ins)"
    " SELECT version, node AS path, bool_or(own) AS is_input FROM every JOIN ins ON root = ins.path GROUP BY version, node",
    edges=EDGES,
    sources=SOURCES,
)
def sources_by_version(spark, edges, sources):
    """Inputs with what they import, once for each version."""
    inputs = sources.select("path", F.lit("Solidity").alias("language"), F.when(F.col("size") % 2 == 0, "0.8.0").otherwise("0.7.6").alias("version"), F.lit("default").alias("profile"))
    return graph.sources_by_version(edges, inputs).select("version", "path", "is_input")


_IGNORED = """(severity = 'warning' AND error_code IS NOT NULL AND (error_code = 2019 OR file = 'lib' OR starts_with(file, 'lib/') OR ((starts_with(file, 'src/')) AND error_code = 2018) OR (ends_with(file, '.t.sol') AND error_code IN (1878, 5574))))"""


@_query(f"SELECT id, {_IGNORED} AS ignored FROM diagnostics", diagnostics=DIAGNOSTICS)
def ignored_diagnostics(spark, diagnostics):
    """Warnings that codes, files, both, or test files excuse."""
    return filters.ignored(diagnostics, [2019], ["lib"], [("src/", [2018])]).select("id", "ignored")


@_query(f"SELECT job, bool_or(NOT {_IGNORED}) AS has_error, bool_or(NOT {_IGNORED}) AS has_warning FROM diagnostics GROUP BY job", diagnostics=DIAGNOSTICS)
def failed_jobs(spark, diagnostics):
    """Whether each job has an error when warnings count."""
    return filters.has_error(filters.ignored(diagnostics, [2019], ["lib"], [("src/", [2018])]), "warning", ["job"])


_MAP = """SELECT l_orderkey AS id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS pos,
  CASE WHEN l_linenumber % 3 = 2 THEN '' ELSE CAST(l_partkey AS STRING) END AS s, CASE WHEN l_suppkey % 4 = 0 THEN '' ELSE CAST(l_suppkey AS STRING) END AS l,
  CASE WHEN l_linenumber % 5 = 4 THEN '-1' WHEN l_linenumber % 2 = 0 THEN '' ELSE CAST(l_linenumber AS STRING) END AS f,
  CASE l_returnflag WHEN 'A' THEN 'i' WHEN 'N' THEN '' ELSE 'o' END AS j FROM {lineitem}"""


@_query(
    """WITH held AS (SELECT id, pos, last_value(nullif(s, '') IGNORE NULLS) OVER w AS s, last_value(nullif(l, '') IGNORE NULLS) OVER w AS l, last_value(nullif(f, '') IGNORE NULLS) OVER w AS f, last_value(nullif(j, '') IGNORE NULLS) OVER w AS j
      FROM parts WINDOW w AS (PARTITION BY id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
    SELECT id, pos, coalesce(CAST(s AS BIGINT), 0) AS "offset", coalesce(CAST(l AS BIGINT), 0) AS "length", CASE WHEN CAST(f AS BIGINT) >= 0 THEN CAST(f AS BIGINT) END AS "index", coalesce(j, 'i') AS jump, 0 AS modifier_depth FROM held""",
    parts=_MAP,
)
def source_map_decoding(spark, parts):
    """Delta-coded source maps, one for each order."""
    text = F.array_sort(F.collect_list(F.struct("pos", F.concat_ws(":", "s", "l", "f", "j").alias("t"))))
    maps = parts.groupBy("id").agg(F.array_join(F.transform(text, lambda x: x["t"]), ";").alias("source_map"))
    return sourcemap.decode(maps)


@_query(
    """WITH old AS (SELECT path, CASE WHEN id % 5 = 0 THEN NULL WHEN id % 7 = 0 THEN 'x' ELSE md5(content) END AS h FROM sources WHERE id % 3 <> 0)
    SELECT s.path, CASE WHEN o.path IS NULL THEN 'missing entry' WHEN h IS NULL THEN 'missing hash' WHEN h <> md5(content) THEN 'hash differs' END AS reason FROM sources s LEFT JOIN old o ON s.path = o.path""",
    sources=SOURCES,
)
def dirty_reasons(spark, sources):
    """Why files have to be compiled again."""
    now = incremental.hashed(sources).withColumn("interface_hash", F.lit(None).cast("string"))
    old = now.where("id % 3 <> 0").select("path", F.when(F.col("id") % 5 == 0, None).when(F.col("id") % 7 == 0, "x").otherwise(F.col("content_hash")).alias("content_hash"), "interface_hash")
    return incremental.dirty_reasons(now, old)


_KEYED = "SELECT path, name, version, profile, max(artifact_path) AS artifact_path, max(build_id) AS build_id FROM artifacts WHERE ordinal % 2 = {n} GROUP BY ALL"


@_query(
    f"""WITH cached AS ({_KEYED.format(n=0)}), written AS ({_KEYED.format(n=1)}), scope AS (SELECT DISTINCT path, version FROM artifacts WHERE ordinal % 3 <> 0)
    SELECT path, name, version, artifact_path FROM cached c WHERE EXISTS (SELECT 1 FROM scope s WHERE s.path = c.path AND s.version = c.version) AND NOT starts_with(path, 'src/d5/')
      AND NOT EXISTS (SELECT 1 FROM written w WHERE w.path = c.path AND w.name = c.name AND w.version = c.version) UNION ALL SELECT path, name, version, artifact_path FROM written""",
    artifacts=ARTIFACTS,
)
def cache_after_run(spark, artifacts):
    """Cached artifacts that stay, and the ones that a run has written."""
    keyed = lambda n: artifacts.where(f"ordinal % 2 = {n}").groupBy(*incremental.KEY).agg(F.max("artifact_path").alias("artifact_path"), F.max("build_id").alias("build_id"))
    scope = artifacts.where("ordinal % 3 <> 0").select("path", "version")
    dirty = artifacts.where("startswith(path, 'src/d5/')").select("path")
    return incremental.consume(keyed(0), scope, dirty, keyed(1)).select("path", "name", "version", "artifact_path")


@_query(
    """WITH have AS (SELECT path, version, bool_or(ordinal % 11 = 0) AS gone FROM artifacts WHERE ordinal % 4 <> 0 GROUP BY ALL), files AS (SELECT DISTINCT path, version FROM artifacts), entries AS (SELECT DISTINCT path FROM artifacts WHERE NOT starts_with(path, 'src/d2/'))
    SELECT f.path, f.version, CASE WHEN e.path IS NULL THEN 'missing entry' WHEN NOT EXISTS (SELECT 1 FROM have x WHERE x.path = f.path) THEN NULL WHEN h.path IS NULL THEN 'missing version and profile' WHEN gone THEN 'missing artifact file' END AS reason
    FROM files f LEFT JOIN entries e ON e.path = f.path LEFT JOIN have h ON h.path = f.path AND h.version = f.version""",
    artifacts=ARTIFACTS,
)
def missing_artifacts(spark, artifacts):
    """Why artifacts have to be made."""
    entries = artifacts.where("not startswith(path, 'src/d2/')").select("path").distinct().withColumn("seen", F.lit(True))
    files = artifacts.select("path", "version", "profile").distinct()
    listing = artifacts.where("ordinal % 11 <> 0").select(F.col("artifact_path").alias("path"))
    return incremental.missing_artifacts(files, entries, artifacts.where("ordinal % 4 <> 0"), listing).select("path", "version", "reason")


@_query("SELECT path, name, min(struct_pack(version := version, artifact_path := artifact_path)).artifact_path AS artifact_path, count(*) AS n FROM artifacts GROUP BY path, name", artifacts=ARTIFACTS)
def first_artifacts(spark, artifacts):
    """The first artifact of each file and name."""
    first = resolve.first_in_order(artifacts.select("path", "name", "version", "artifact_path"), ["path", "name"], ["version", "artifact_path"])
    return first.join(artifacts.groupBy("path", "name").agg(F.count(F.lit(1)).alias("n")), ["path", "name"]).select("path", "name", "artifact_path", "n")


@_query("SELECT path, string_agg(DISTINCT version, ',' ORDER BY version) AS versions FROM artifacts GROUP BY path", artifacts=ARTIFACTS)
def versions_by_file(spark, artifacts):
    return outputs.versions_by_file(artifacts).select("path", F.array_join("versions", ",").alias("versions"))


@_query("SELECT build_id FROM (SELECT DISTINCT build_id FROM artifacts) WHERE build_id NOT IN (SELECT build_id FROM artifacts WHERE ordinal % 101 < 60)", artifacts=ARTIFACTS)
def unused_builds(spark, artifacts):
    return incremental.unused_builds(artifacts.select("build_id").distinct(), artifacts.where("ordinal % 101 < 60"))


@_query(
    """WITH v AS (SELECT path, name, version, count(DISTINCT version) OVER (PARTITION BY path, name) AS n FROM (SELECT DISTINCT path, name, version FROM artifacts))
    SELECT path, name, version, regexp_extract(path, '([^/]*)$', 1) || '/' || name || CASE WHEN n > 1 THEN '.' || version ELSE '' END || '.json' AS file FROM v""",
    artifacts=ARTIFACTS,
)
def artifact_names(spark, artifacts):
    """Artifact files, with the version in the name where a contract has several."""
    return outputs.artifact_files(artifacts.select("path", "name", "version", "profile").distinct()).drop("profile")


@_query(
    """WITH w(name, rank, a, b, c) AS (VALUES """ + ", ".join(str((n, versions.EVM_VERSIONS.index(n), *s)) for n, s in versions.EVM_SINCE.items()) + """),
    every AS (SELECT id, size % 14 AS want, 4 + size % 5 AS b, id % 31 AS c FROM sources), top AS (SELECT id, want, max(rank) AS top FROM every LEFT JOIN w ON every.b > w.b OR (every.b = w.b AND every.c >= w.c) GROUP BY ALL)
    SELECT id, CASE WHEN top IS NOT NULL THEN least(want, top) END AS evm FROM top""",
    sources=SOURCES,
)
def evm_versions(spark, sources):
    """Requested EVM versions, lowered to what the compiler knows."""
    v = F.array(F.lit(0), F.lit(4) + F.col("size") % 5, (F.col("id") % 31).cast("int"))
    found = versions.normalise_evm(versions.evm_name((F.col("size") % 14 + 1).cast("int")), v)
    return sources.select("id", (versions.evm_rank(found) - 1).alias("evm"))


@_query(
    """WITH r AS (SELECT id, CASE WHEN id % 3 = 0 THEN NULL ELSE size - 10 END AS lo1, CASE WHEN id % 4 = 0 THEN NULL ELSE size + 5 END AS hi1, CASE WHEN id % 5 = 0 THEN NULL ELSE id % 40 END AS lo2, CASE WHEN id % 7 = 0 THEN NULL ELSE id % 60 END AS hi2, CASE WHEN id % 6 = 0 THEN NULL ELSE id % 50 END AS value FROM sources),
    m AS (SELECT id, value, CASE WHEN lo1 IS NULL THEN lo2 WHEN lo2 IS NULL THEN lo1 ELSE greatest(lo1, lo2) END AS lo, CASE WHEN hi1 IS NULL THEN hi2 WHEN hi2 IS NULL THEN hi1 ELSE least(hi1, hi2) END AS hi FROM r)
    SELECT id, lo, hi, CASE WHEN value IS NULL THEN coalesce(lo, hi) WHEN value < lo THEN lo WHEN value > hi THEN hi ELSE value END AS value, (lo IS NULL OR coalesce(value >= lo, false)) AND (hi IS NULL OR coalesce(value <= hi, false)) AS ok FROM m WHERE NOT coalesce(lo > hi, false)""",
    sources=SOURCES,
)
def merged_restrictions(spark, sources):
    """Intervals merged, conflicts left out, and a value checked and clamped."""
    c = lambda k, x: F.when(F.col("id") % k != 0, x).cast("long")
    rows = sources.select("id", versions.merge_restrictions(c(3, F.col("size") - 10), c(4, F.col("size") + 5), c(5, F.col("id") % 40), c(7, F.col("id") % 60)).alias("r"), c(6, F.col("id") % 50).alias("value"))
    lo, hi, value = F.col("r.min"), F.col("r.max"), F.col("value")
    return rows.where("r is not null").select("id", lo.alias("lo"), hi.alias("hi"), versions.apply_restriction(lo, hi, value).alias("value"), versions.satisfies(lo, hi, value).alias("ok"))


@_query(
    """WITH p AS (SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS path FROM pages)
    SELECT page_id, path, regexp_extract(path, '([^/]*)$', 1) AS file_name, CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '' END AS parent,
      CASE WHEN starts_with(path, 'www.') THEN substr(path, 5) ELSE path END AS stripped FROM p""",
    pages="SELECT page_id, url FROM {pages}",
)
def path_parts(spark, pages):
    """Names and parents of paths."""
    p = pages.select("page_id", F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "").alias("path"))
    c = F.col("path")
    return p.select("page_id", "path", paths.file_name(c).alias("file_name"), paths.parent(c).alias("parent"), F.regexp_replace(c, r"^www\.", "").alias("stripped"))


@_query(
    """WITH p AS (SELECT id, path, 'src/d' || CAST(id % 3 AS STRING) || '/./x/../y' AS base FROM sources)
    SELECT id, 'src/d' || CAST(id % 3 AS STRING) || '/y' AS cleaned, CASE WHEN split_part(path, '/', 2) = 'd' || CAST(id % 3 AS STRING) THEN '../' || split_part(path, '/', 3) ELSE '../../' || split_part(path, '/', 2) || '/' || split_part(path, '/', 3) END AS rebased,
      CASE WHEN split_part(path, '/', 2) = 'd' || CAST(id % 3 AS STRING) THEN 'src/' || split_part(path, '/', 2) ELSE 'src' END AS ancestor FROM p""",
    sources=SOURCES,
)
def path_rewriting(spark, sources):
    """Paths cleaned, rebased and compared."""
    base = F.concat(F.lit("src/d"), (F.col("id") % 3).cast("string"), F.lit("/./x/../y"))
    return sources.select("id", paths.clean_path(base).alias("cleaned"), paths.rebase_path(base, F.col("path")).alias("rebased"), paths.common_ancestor(paths.clean_path(base), F.col("path")).alias("ancestor"))


@_query(
    """WITH p AS (SELECT brand, unnest(string_split(CASE size % 5 WHEN 0 THEN '^0.8.0' WHEN 1 THEN '>=0.7.0 <0.9.0' WHEN 2 THEN '0.8.19' WHEN 3 THEN '~0.8.4' ELSE '^0.7.5' END, ' ')) AS part FROM sources)
    SELECT brand, string_agg(DISTINCT part, ' ' ORDER BY part) AS pragma FROM p GROUP BY brand""",
    sources=SOURCES,
)
def combined_pragmas(spark, sources):
    return outputs.combined_pragmas(sources.withColumn("version_text", solidity.version_text(F.col("content"))), ["brand"])


@_query(
    """SELECT id, '6080' || CASE WHEN id % 4 = 0 THEN repeat('ab', 20) ELSE '__' || rpad(substr('src/' || brand || '.sol:Lib', 1, 36), 36, '_') || '__' END || 'f3' AS linked, id % 4 <> 0 AS unlinked FROM sources""",
    sources=SOURCES,
)
def linked_bytecode(spark, sources):
    """Placeholders of some libraries replaced by addresses."""
    name = F.concat(F.lit("src/"), "brand", F.lit(".sol:Lib"))
    code = F.concat(F.lit("6080__"), bytecode.name_placeholder(name), F.lit("__f3"))
    linked = F.when(F.col("id") % 4 == 0, bytecode.link(code, name, F.lit("0" * 34), F.lit("0x" + "AB" * 20))).otherwise(code)
    return sources.select("id", linked.alias("linked"), bytecode.is_unlinked(linked).alias("unlinked"))


@_query(
    """SELECT id, path, replace(replace(content, chr(10), chr(10) || '//'), 'pragma', 'PRAGMA') AS content FROM (SELECT id, path, 'pragma é' || chr(10) || brand AS content FROM sources)""",
    sources=SOURCES,
)
def applied_edits(spark, sources):
    """Edits by byte ranges, past characters of several bytes."""
    some = sources.select("id", "path", F.concat(F.lit("pragma é\n"), "brand").alias("content"))
    at = lambda a, b, t: some.select("path", F.lit(a).cast("long").alias("start"), F.lit(b).cast("long").alias("end"), F.lit(t).alias("text"))
    return edits.apply_edits(some, at(0, 6, "PRAGMA").unionByName(at(10, 10, "//")))


_TREE = """SELECT p_partkey AS id, concat('T', CAST(p_partkey AS STRING)) AS path, p_size AS size, concat('{"nodeType":"SourceUnit","id":', CAST(p_partkey * 10 AS STRING), ',"src":"0:90:1","nodes":[{"nodeType":"ContractDefinition","name":"', replace(p_brand, '#', '_'), '","id":', CAST(p_partkey * 10 + 1 AS STRING),
  ',"src":"5:60:1","contractKind":"', CASE WHEN p_size % 2 = 0 THEN 'library' ELSE 'contract' END, '","nodes":[{"nodeType":"FunctionDefinition","name":"f","visibility":"public","id":', CAST(p_partkey * 10 + 2 AS STRING), ',"src":"9:20:1"},{"nodeType":"Identifier","name":"x","id":', CAST(p_partkey * 10 + 3 AS STRING), ',"src":"30:1:-1","referencedDeclaration":', CAST(p_partkey * 10 + 2 AS STRING), '}]}]}') AS ast FROM {part}"""


@_query(
    """SELECT path, unnest([0, 1, 2, 3]) AS place, unnest(['SourceUnit', 'ContractDefinition', 'FunctionDefinition', 'Identifier']) AS node_type, unnest([0, 1, 2, 2]) AS depth, unnest([NULL, id * 10, id * 10 + 1, id * 10 + 1]) AS parent_id, unnest([1, 1, 1, NULL]) AS source, unnest([NULL, NULL, NULL, id * 10 + 2]) AS referenced,
       unnest([NULL, NULL, 'public', NULL]) AS visibility FROM trees""",
    trees=_TREE,
)
def syntax_tree_walk(spark, trees):
    """Nodes of syntax trees in order, with an attribute."""
    n = ast.walk(trees)
    return n.select("path", "place", "node_type", "depth", "parent_id", "source", "referenced", ast.attribute(F.col("attributes"), "visibility", "string").alias("visibility"))


@_query(
    """SELECT path, name, n_definitions, CASE WHEN n_definitions > 1 THEN name || '_' || CAST(i AS STRING) ELSE name END AS new_name FROM (
      SELECT path, regexp_extract(ast, '"ContractDefinition","name":"([^"]*)"', 1) AS name, count(*) OVER (PARTITION BY name) AS n_definitions, row_number() OVER (PARTITION BY name ORDER BY id) - 1 AS i FROM trees)""",
    trees=_TREE,
)
def renamed_definitions(spark, trees):
    """Top-level definitions of one name told apart."""
    nodes = Written(ast.walk(trees), "nodes").df
    renamed = edits.renamed_definitions(nodes, trees.select("path", F.col("id").alias("place")))
    counts = ast.top_level_definitions(nodes).select("name", F.size("definitions").cast("long").alias("n_definitions"))
    return renamed.join(counts, "name").select("path", "name", "n_definitions", "new_name")


#: The same files with a second pragma in some, and with a name that is an alias, a string and part of a comment.
FLAT = f"""SELECT id, path, size, brand, replace(replace(content, concat(';', chr(10), 'import "./'), concat(';', chr(10), CASE WHEN size % 4 = 0 THEN concat('pragma abicoder v', CAST(id % 3 AS STRING), ';', chr(10)) ELSE '' END, 'import "./')),
  concat(' {{}}', chr(10), 'library'), concat(' is T {{ string s = "T"; T t = T.make(xT, ''T''); /* T */ function T() }} // T or T', chr(10), 'library')) AS content FROM ({SOURCES}) AS s"""


@_query(
    f"RECURSIVE WITH {_CLOSURE}, own AS (SELECT DISTINCT src AS f FROM edges UNION SELECT dst FROM edges UNION SELECT path FROM sources), every AS (SELECT root, node FROM reach UNION SELECT f, f FROM own)"
    """, sizes AS (SELECT root AS node, count(*) AS n FROM every GROUP BY root), placed AS (SELECT root, node, row_number() OVER (PARTITION BY root ORDER BY node = root, n, regexp_extract(node, '([^/]*)$', 1), node) AS place FROM every JOIN sizes USING (node)),
    facts AS (SELECT path, CASE WHEN size % 3 = 0 THEN '// SPDX-License-Identifier: MIT' || chr(10) ELSE '' END AS license, CASE WHEN size % 4 = 0 THEN 'pragma abicoder v' || CAST(id % 3 AS VARCHAR) || ';' END AS special, regexp_extract(content, 'pragma solidity (.+?);', 1) AS version,
      '// ' || path || repeat(chr(10), 4 + (size % 3 = 0)::INT + (size % 4 = 0)::INT) || 'contract ' || replace(brand, '#', '_') || ' is Token { string s = "T"; Token t = Token.make(xT, ''T''); /* T */ function T() } // T or T' || chr(10) || regexp_extract(content, '(library .*)', 1) || chr(10) AS body FROM sources),
    parts AS (SELECT root, string_agg(DISTINCT p, ' ' ORDER BY p) AS pragma FROM (SELECT root, unnest(string_split(version, ' ')) AS p FROM placed JOIN facts ON node = path) GROUP BY root),
    joined AS (SELECT root, max(license) FILTER (node = root) AS license, arg_min(special, place) FILTER (special IS NOT NULL) AS special, string_agg(body, chr(10) ORDER BY place) AS bodies FROM placed JOIN facts ON node = path GROUP BY root)
    SELECT root AS target, regexp_replace(license || 'pragma solidity ' || pragma || ';' || chr(10) || coalesce(special || chr(10), '') || rtrim(bodies, chr(10)), '\\n{3,}', chr(10) || chr(10), 'g') || chr(10) AS content FROM joined JOIN parts USING (root) WHERE root IN (SELECT path FROM sources)""".replace("\\\\n", "\\n"),
    edges=EDGES,
    sources=FLAT,
)
def flattened_sources(spark, edges, sources):
    """Every file in one text with all that it imports."""
    return edits.flatten(sources, edges, sources.select("path"))


@_query(
    """RECURSIVE WITH asked AS (SELECT DISTINCT path, lower(name) AS name, 'X/' || lower(name) || '.json' AS file FROM artifacts), used AS (SELECT DISTINCT 'd' || CAST(ordinal % 17 AS VARCHAR) || '/X/n2.json' AS file FROM artifacts WHERE ordinal % 17 < 3 UNION SELECT 'X/n1.json'),
    rows AS (SELECT path, name, file, row_number() OVER (PARTITION BY file ORDER BY path) AS r, split_part(path, '/', 2) AS d FROM asked),
    first AS (SELECT path, name, file AS got, file NOT IN (SELECT file FROM used) AND r = 1 AS ok, d, file FROM rows),
    second AS (SELECT path, name, d || '/' || file AS got, row_number() OVER (PARTITION BY file, d ORDER BY path) = 1 AND d || '/' || file NOT IN (SELECT file FROM used) AS ok, d, file FROM first WHERE NOT ok),
    third AS (SELECT path, name, 'src/' || d || '/' || file AS got, row_number() OVER (PARTITION BY file, d ORDER BY path) = 1 AS ok, d, file FROM second WHERE NOT ok),
    fourth AS (SELECT path, name, 'X_' || CAST(row_number() OVER (PARTITION BY file ORDER BY path) AS VARCHAR) || substr(file, 2) AS got FROM third WHERE NOT ok)
    SELECT path, name, got AS file FROM first WHERE ok UNION ALL SELECT path, name, got FROM second WHERE ok UNION ALL SELECT path, name, got FROM third WHERE ok UNION ALL SELECT path, name, got FROM fourth""",
    artifacts=ARTIFACTS,
)
def conflict_free_files(spark, artifacts):
    """Artifact files made unique, ignoring case, with some names that are taken."""
    rows = artifacts.select("path", F.lower("name").alias("name")).distinct().withColumn("file", F.concat(F.lit("X/"), "name", F.lit(".json")))
    used = artifacts.where("ordinal % 17 < 3").select(F.concat(F.lit("D"), (F.col("ordinal") % 17).cast("string"), F.lit("/X/N2.json")).alias("file")).unionByName(spark.createDataFrame([("x/n1.json",)], "file string").select(F.replace("file", F.lit("x/"), F.lit("X/")).alias("file")))
    return outputs.conflict_free(rows, used)


@_query(
    f"RECURSIVE WITH {_CLOSURE}, every AS (SELECT root, node FROM reach UNION SELECT path, path FROM sources),"
    + """ v(i, b, c) AS (VALUES """
    + ", ".join(str((i, *x[1:])) for i, x in enumerate(_INSTALLED[:-1]))
    + """),
    masks AS (SELECT path, bit_or(1::BIGINT << i) FILTER (CASE size % 5 WHEN 0 THEN b = 8 WHEN 1 THEN b IN (7, 8) WHEN 2 THEN b = 8 AND c = 19 WHEN 3 THEN b = 8 AND c >= 4 ELSE b = 7 AND c >= 5 END) AS m FROM sources, v GROUP BY path),
    able AS (SELECT root AS path, bit_and(m) AS m FROM every JOIN masks ON node = path GROUP BY root HAVING bit_and(m) <> 0), common AS (SELECT bit_and(m) AS all_of FROM able), ok AS (SELECT path, m, all_of, row_number() OVER (ORDER BY path) AS n FROM able, common),
    walk AS (SELECT 0::BIGINT AS n, NULL::VARCHAR AS path, 0 AS pick, 0::BIGINT AS taken UNION ALL
      SELECT n, path, pick, taken | (1::BIGINT << pick) FROM (SELECT ok.n, ok.path, taken, floor(log2(CASE WHEN all_of <> 0 THEN all_of WHEN m & taken <> 0 THEN m & taken ELSE m END))::INT AS pick FROM walk JOIN ok ON ok.n = walk.n + 1))
    SELECT path, '0.' || b || '.' || c AS version FROM walk JOIN v ON pick = i WHERE path IS NOT NULL""",
    sources=SOURCES,
    edges=EDGES,
)
def solved_versions(spark, sources, edges):
    """A version for every file that can have one, by what it and its imports demand: one that all can take, or else in turn."""
    v = spark.createDataFrame([(list(x),) for x in _INSTALLED], "v array<int>")
    reqs = solve.parsed_requirements(sources.select("path", solidity.version_text(F.col("content")).alias("version_text")))
    got = solve.chosen_versions(solve.compatible_versions(reqs, edges, sources.select("path"), solve.available_versions(v)))
    return got.select("path", F.array_join(F.col("v").cast("array<string>"), ".").alias("version"))


@_query("SELECT id, id % 2 = 0 OR id % 3 = 0 AS subset FROM sources", sources=SOURCES)
def selection_subsets(spark, sources):
    """Whether an output selection is part of another."""
    pick = lambda x: F.create_map(F.lit("*"), F.create_map(F.lit("*"), x))
    a = F.when(F.col("id") % 2 == 0, F.array(F.lit("abi"))).when(F.col("id") % 3 == 0, F.array(F.lit("abi"), F.lit("ir"))).otherwise(F.array(F.lit("abi"), F.lit("ewasm")))
    return sources.select("id", filters.is_subset(pick(a), pick(F.array(F.lit("abi"), F.lit("ir")))).alias("subset"))


_FUNCTIONS = """SELECT p_partkey AS id, concat('I', CAST(p_partkey AS STRING)) AS path, concat('contract C {', chr(10), '  function a() internal {}', chr(10), '  function b() public { }', chr(10), '}  //', p_brand) AS content,
  concat('{"nodeType":"SourceUnit","id":1,"src":"0:90:1","nodes":[{"nodeType":"ContractDefinition","name":"C","id":2,"src":"0:70:1","contractKind":"', CASE WHEN p_size % 3 = 0 THEN 'library' ELSE 'contract' END,
  '","nodes":[{"nodeType":"FunctionDefinition","name":"a","visibility":"internal","id":3,"src":"15:24:1"},{"nodeType":"FunctionDefinition","name":"b","visibility":"public","id":4,"src":"42:23:1","body":{"nodeType":"Block","id":5,"src":"62:3:1"}}]}]}') AS ast, p_size AS size, p_brand AS brand FROM {part}"""


@_query(
    """SELECT path, CASE WHEN size % 4 = 0 THEN md5(content) WHEN size % 3 = 0 THEN md5('contract C { function a() internal {} function b() public { }} //' || brand) ELSE md5('contract C { function b() public ;} //' || brand) END AS interface_hash FROM files""",
    files=_FUNCTIONS,
)
def interface_hashes(spark, files):
    """Hashes of what other files can see of a source; of some there is no syntax tree."""
    return edits.interface_hashes(files, Written(ast.walk(files.where("size % 4 <> 0")), "nodes").df)


@_query(
    """WITH want AS (SELECT id, 'p' || CAST(id % 40 AS STRING) AS pkg FROM sources), lib(ordinal, root) AS (VALUES (0, 'lib'), (1, 'node_modules')),
    listing AS (SELECT DISTINCT CASE WHEN id % 40 % 3 = 0 THEN 'lib/p' || CAST(id % 40 AS STRING) || '/src/X.sol' WHEN id % 40 % 3 = 1 THEN 'node_modules/p' || CAST(id % 40 AS STRING) || '/X.sol' END AS path FROM sources),
    tries AS (SELECT id, ordinal, 0 AS form, root || '/' || pkg || '/X.sol' AS path FROM want, lib UNION ALL SELECT id, ordinal, 1, root || '/' || pkg || '/src/X.sol' FROM want, lib)
    SELECT id, arg_min(path, ordinal * 2 + form) AS path FROM tries WHERE path IN (SELECT path FROM listing WHERE path IS NOT NULL) GROUP BY id""",
    sources=SOURCES,
)
def library_lookup(spark, sources):
    """Imports found in library folders, in order, with or without src."""
    pkg = F.concat(F.lit("p"), (F.col("id") % 40).cast("string"))
    three = F.col("id") % 40 % 3
    listing = sources.select(F.when(three == 0, F.concat(F.lit("lib/"), pkg, F.lit("/src/X.sol"))).when(three == 1, F.concat(F.lit("node_modules/"), pkg, F.lit("/X.sol"))).alias("path")).where("path is not null")
    libraries = spark.createDataFrame([(0, "lib"), (1, "node_modules")], "ordinal int, path string")
    return resolve.from_libraries(sources.select("id", F.concat(pkg, F.lit("/X.sol")).alias("import")), libraries, listing)


@_query("SELECT path, CASE WHEN starts_with(path, 'src/d1/') THEN 'src/d1' WHEN starts_with(path, 'src/') THEN 'src' END AS library FROM sources", sources=SOURCES)
def library_ancestors(spark, sources):
    """The first library folder that a file lies under."""
    libraries = spark.createDataFrame([(0, "src/d1"), (1, "src/"), (2, "src/d2")], "ordinal int, path string")
    return resolve.library_ancestor(sources.select(F.col("path").alias("id"), "path"), libraries).select(F.col("id").alias("path"), "library")


@_query("SELECT DISTINCT e.src AS path, e.dst AS dependency FROM edges e JOIN sources s ON e.dst = s.path WHERE s.size % 2 = 0", edges=EDGES, sources=SOURCES)
def linking_dependencies(spark, edges, sources):
    """Imported files that contain a library."""
    return graph.linking_dependencies(edges, edges.select(F.col("src").alias("path")), sources.where("size % 2 = 0"))


@_query(
    "RECURSIVE WITH reach AS (SELECT DISTINCT dst AS path FROM edges JOIN sources ON src = path AND size = 7 UNION SELECT dst FROM reach JOIN edges ON src = path)"
    " SELECT path, 'Complete' AS kind FROM sources WHERE size = 7 UNION ALL SELECT path, 'Optimized' FROM reach WHERE path IN (SELECT path FROM sources WHERE size <> 7)",
    edges=EDGES,
    sources=SOURCES,
)
def compilation_kinds(spark, edges, sources):
    """Files to compile in full, and what they import."""
    return incremental.job_kinds(sources, sources.where("size = 7"), edges)


@_query(
    """WITH now AS (SELECT DISTINCT brand AS profile, size % 4 AS runs FROM sources WHERE id % 2 = 0 QUALIFY row_number() OVER (PARTITION BY brand ORDER BY id) = 1), old AS (SELECT DISTINCT brand AS profile, size % 4 AS runs FROM sources WHERE id % 3 = 0 QUALIFY row_number() OVER (PARTITION BY brand ORDER BY id) = 1)
    SELECT o.profile, coalesce(o.runs = n.runs, false) AS keep FROM old o LEFT JOIN now n ON o.profile = n.profile""",
    sources=SOURCES,
)
def reusable_profiles(spark, sources):
    """Cached settings profiles that are still the project's."""
    pick = lambda k: resolve.first_in_order(sources.where(f"id % {k} = 0").select(F.col("brand").alias("profile"), (F.col("size") % 4).alias("runs"), "id"), ["profile"], ["id"])
    return incremental.reusable_profiles(pick(3), pick(2), ["runs"])


@_query("SELECT version, count(*) AS n, string_agg(path || ':' || name, ',' ORDER BY path, name) FILTER (starts_with(path, 'src/d3/C3.')) AS some FROM (SELECT DISTINCT path, name, version FROM artifacts) GROUP BY version", artifacts=ARTIFACTS)
def contracts_by_version(spark, artifacts):
    """Contracts of every compiler version."""
    got = outputs.by_version(artifacts.select("path", "name", "version").distinct())
    some = F.filter("contracts", lambda c: F.startswith(c["path"], F.lit("src/d3/C3.")))
    return got.select("version", F.size("contracts").cast("long").alias("n"), F.nullif(F.array_join(F.transform(some, lambda c: F.concat_ws(":", c["path"], c["name"])), ","), F.lit("")).alias("some"))


@_query("SELECT brand, CASE WHEN count(DISTINCT split_part(path, '/', 2)) = 1 THEN 'src/' || min(split_part(path, '/', 2)) ELSE 'src' END AS ancestor FROM sources GROUP BY brand HAVING count(*) > 1", sources=SOURCES)
def common_folders(spark, sources):
    """The folder that all files of a group share."""
    many = sources.groupBy("brand").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("brand")
    return outputs.common_ancestor_all(sources.join(many, "brand", "left_semi"), ["brand"])


@_query("SELECT version, count(*) AS n_files, CAST(sum(length(content)) AS BIGINT) AS n_chars FROM (SELECT content, CASE WHEN size % 2 = 0 THEN '0.8.0' ELSE '0.7.6' END AS version FROM sources) GROUP BY version", sources=SOURCES)
def compile_jobs(spark, sources):
    """One JSON input for each group of files, read back."""
    from buildlens.plans.planner import job_inputs

    jobs = sources.select("path", F.lit("Solidity").alias("language"), F.when(F.col("size") % 2 == 0, "0.8.0").otherwise("0.7.6").alias("version"), F.lit("default").alias("profile"))
    files = F.map_values(F.from_json(F.get_json_object("input", "$.sources"), "map<string, struct<content: string>>"))
    return job_inputs(jobs, sources).select("version", F.size(files).cast("long").alias("n_files"), F.aggregate(files, F.lit(0).cast("long"), lambda n, s: n + F.length(s["content"])).alias("n_chars"))


def streamed_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions of sources by ten minutes, counted by a stream over the events that are there."""
    from buildlens.streaming.watch import change_counts

    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    versions_ = stream.select(F.concat(F.lit("src/F"), F.col("user_id").cast("string")).alias("path"), F.col("ts").cast("timestamp").alias("at"))
    held = f"{shared_dir(spark).rstrip('/')}/buildlens/{spark.sparkContext.applicationId}/stream-{uuid.uuid4().hex[:12]}"
    counts = change_counts(versions_)

    def write(batch: DataFrame, number: int) -> None:  # a window's last count stands
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{held}/counts/{number}")

    counts.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{held}/state").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.option("recursiveFileLookup", True).parquet(f"{held}/counts")
    return rows.groupBy(F.unix_seconds("window.start").alias("start")).agg(F.max_by("versions", "batch").alias("versions"))


QUERIES["streamed_versions"] = streamed_versions
ORACLE_SQL["streamed_versions"] = "SELECT CAST(floor(epoch(ts) / 600) AS BIGINT) * 600 AS start, count(*) AS versions FROM events GROUP BY 1"

from buildlens.plans import further_queries  # noqa: E402, F401  registers its queries here

"""From sources to compile jobs, and from job outputs back to tables.

A compiler is an outside program; a job is a row, and whatever runs it (a program on the executors, or outputs that are
already there) is a function from a job's JSON input to JSON output.
"""

from __future__ import annotations

import io
import json
import subprocess
import tempfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from buildlens.functions import solidity
from buildlens.functions.paths import guess_language, parent
from buildlens.functions.versions import version
from buildlens.operators import graph, incremental, outputs, resolve, solve
from buildlens.sources import json_parts, sinks
from buildlens.storage import Written


@dataclass
class Project:
    """Configuration: ordered remappings (context, name, path) and libraries, and the directories to fall back to."""

    remappings: list[tuple[str | None, str, str]] = field(default_factory=list)
    libraries: list[str] = field(default_factory=list)
    fallback_dirs: list[str] = field(default_factory=list)
    profile: str = "default"
    offline: bool = True


def parsed_sources(sources: DataFrame) -> DataFrame:
    """sources (path, content) with license, version_text, requirement, imports, libraries, contract_names, is_yul and
    language, by patterns."""
    c = F.col("content")
    parsed = sources.withColumns(
        {
            "license": solidity.license_of(c), "version_text": F.coalesce(solidity.version_text(c), solidity.vyper_version(c)), "imports": solidity.imports(c), "libraries": solidity.libraries(c),
            "contract_names": solidity.contract_names(c), "is_yul": solidity.is_yul(F.col("path")), "language": guess_language(F.col("path")),
        }
    )
    return parsed.join(solve.parsed_requirements(parsed), "path")


def import_graph(parsed: DataFrame, project: Project) -> tuple[DataFrame, DataFrame]:
    """(edges src, dst; unresolved import, file) of parsed sources."""
    spark = parsed.sparkSession
    rows = resolve.import_rows(parsed.select("path", "imports"))
    rows = rows.select(F.concat_ws("\x00", "file", F.col("ordinal").cast("string")).alias("id"), "file", parent(F.col("file")).alias("cwd"), "import")
    rules = spark.createDataFrame([(i, *r) for i, r in enumerate(project.remappings)], "ordinal int, context string, name string, path string")
    libraries = spark.createDataFrame(list(enumerate(project.libraries)), "ordinal int, path string")
    found = resolve.resolve_imports(rows.select("id", "cwd", "import"), rules, libraries, parsed.select("path"), project.fallback_dirs).join(rows.select("id", "file", "import"), "id")
    found = Written(found.select("file", "import", "path", "how"), "imports").df
    return found.where("path is not null").select(F.col("file").alias("src"), F.col("path").alias("dst")).distinct(), graph.unresolved(found)


def plan_jobs(parsed: DataFrame, edges: DataFrame, installed: DataFrame, project: Project, entries: DataFrame | None = None) -> DataFrame:
    """(language, version, profile, path, is_input, dirty): every group's files, and which of them changed since the
    cache (entries) was written; without one all are dirty."""
    inputs = parsed.where("language is not null").select("path", "language")
    versions = solve.available_versions(installed)
    chosen = solve.chosen_versions(solve.compatible_versions(parsed.select("path", "requirement"), edges, inputs, versions))
    groups = graph.sources_by_version(edges, inputs.join(chosen, "path").select("path", "language", F.array_join(F.col("v").cast("array<string>"), ".").alias("version"), F.lit(project.profile).alias("profile")))
    if entries is None:
        return groups.withColumn("dirty", F.lit(True))
    now = incremental.hashed(parsed.select("path", "content")).withColumn("interface_hash", F.lit(None).cast("string"))
    dirty = incremental.dirty_sources(now, entries, edges).withColumn("_dirty", F.lit(True))
    return groups.join(dirty, "path", "left").withColumn("dirty", F.coalesce("_dirty", F.lit(False))).drop("_dirty")


def job_inputs(jobs: DataFrame, sources: DataFrame, settings: str = "{}") -> DataFrame:
    """(job_id, language, version, profile, input): one JSON input for each group, of its files by path.

    A job is one compiler call, and here its files meet in one row; jobs beyond a task's memory are for run_job_streams.
    """
    key = ["language", "version", "profile"]
    rows = jobs.join(sources.select("path", "content"), "path").groupBy(*key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("path", F.struct("content").alias("source"))))).alias("sources"))
    return rows.select(F.md5(F.concat_ws("\x00", *key)).alias("job_id"), *key, F.concat(F.lit('{"language":"'), "language", F.lit('","sources":'), F.to_json("sources"), F.lit(',"settings":'), F.lit(settings), F.lit("}")).alias("input"))


def command_line(v: Column, base_path: Column, include_paths: list[str], allow_paths: list[str]) -> Column:
    """Arguments of a compiler of version v: --base-path from 0.6.9 on, --include-path from 0.8.8 on."""
    args = F.array(F.lit("--standard-json"))
    allow = F.array(F.lit("--allow-paths"), F.lit(",".join(allow_paths))) if allow_paths else F.array().cast("array<string>")
    base = F.when((v >= version(0, 6, 9)) & base_path.isNotNull(), F.array(F.lit("--base-path"), base_path)).otherwise(F.array().cast("array<string>"))
    more = F.array(*[F.lit(x) for p in include_paths for x in ("--include-path", p)]) if include_paths else F.array().cast("array<string>")
    return F.concat(args, allow, base, F.when(v >= version(0, 8, 8), more).otherwise(F.array().cast("array<string>")))


def run_process(program: str, arguments: list[str], text: str, timeout: int = 600) -> str:
    """A compiler program's output for one JSON input; an error if it fails."""
    done = subprocess.run([program, *arguments], input=text, capture_output=True, text=True, timeout=timeout, check=False)
    if done.returncode:
        raise RuntimeError(f"{program} ended with {done.returncode}: {done.stderr[-500:]}")
    return done.stdout


def process_stream(program: str, arguments: list[str], timeout: int = 600) -> Callable[[str, Iterator[str]], Iterator[str]]:
    """A compiler program for run_job_streams: its input and output are files of the task; an error if it fails."""

    def compile_stream(_: str, pieces: Iterator[str]) -> Iterator[str]:
        with tempfile.TemporaryFile() as given, tempfile.TemporaryFile() as out:
            given.writelines(p.encode() for p in pieces)
            given.seek(0)
            done = subprocess.run([program, *arguments], stdin=given, stdout=out, stderr=subprocess.PIPE, timeout=timeout, check=False)
            if done.returncode:
                raise RuntimeError(f"{program} ended with {done.returncode}: {done.stderr[-500:].decode(errors='replace')}")
            out.seek(0)
            text = io.TextIOWrapper(out, "utf-8", newline="")
            yield from iter(lambda: text.read(1 << 16), "")

    return compile_stream


def by_language(programs: dict[str, Callable[[str, str], str]]) -> Callable[[str, str], str]:
    """One function for run_jobs that hands a job to the compiler of its input's language; an error for any other."""

    def compile_one(v: str, text: str) -> str:
        language = json.loads(text)["language"]
        if language not in programs:
            raise ValueError(f"no compiler for {language}")
        return programs[language](v, text)

    return compile_one


def vyper_process(program: str, timeout: int = 600) -> Callable[[str, str], str]:
    """A Vyper program for run_jobs: standard JSON in, standard JSON out, whatever the version."""
    return lambda _, text: run_process(program, ["--standard-json"], text, timeout)


_VERSIONS: dict[tuple, str] = {}


def program_version(program: str, arguments: tuple[str, ...] = ("--version",)) -> str:
    """What a program says its version is; asked once for each program and arguments in a Python process."""
    key = (program, arguments)
    if key not in _VERSIONS:
        done = subprocess.run([program, *arguments], capture_output=True, text=True, timeout=60, check=True)
        lines = [x for x in done.stdout.split("\n") if x.strip()]
        _VERSIONS[key] = lines[-1].strip().removeprefix("Version:").strip().replace(".g++", ".gcc")
    return _VERSIONS[key]


def job_dumps(jobs: DataFrame, column: str, name: str) -> DataFrame:
    """(path, content) of jobs' inputs or outputs for write_files, for a look at them: <name>.<version>.<job>.json."""
    return jobs.select(F.concat(F.lit(name + "."), "version", F.lit("."), "job_id", F.lit(".json")).alias("path"), F.col(column).alias("content"))


def run_jobs(jobs: DataFrame, compile_one: Callable[[str, str], str], parallel: int | None = None) -> DataFrame:
    """(job_id, version, output): compile_one(version, input) for each job, one at a time in every task.

    parallel: the number of tasks (1: one job after the other). Any failure fails the run.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                job, v, text = (b.column(c)[i].as_py() for c in range(3))
                yield pa.RecordBatch.from_arrays([pa.array([job]), pa.array([v]), pa.array([compile_one(v, text)])], ["job_id", "version", "output"])

    rows = jobs.select("job_id", "version", "input")
    return (rows if parallel is None else rows.repartition(parallel, "job_id")).mapInArrow(run, "job_id string, version string, output string")


def _dealt(jobs: DataFrame, parallel: int) -> DataFrame:
    """(job_id, task) for so many tasks: in turn, from the largest job down, as hashes of few jobs often meet."""
    sizes = jobs.groupBy("job_id").agg(F.count(F.lit(1)).alias("n"))
    turn = F.row_number().over(Window.orderBy(F.desc("n"), "job_id"))
    return sizes.select("job_id", ((turn - 1) % parallel).alias("task"))


def run_job_streams(jobs: DataFrame, sources: DataFrame, programs: dict[str, Callable[[str, Iterator[str]], Iterator[str]]], settings: str = "{}", parallel: int | None = None) -> DataFrame:
    """(job_id, version, output) of jobs of any size: job_inputs and run_jobs in one, with a job's rows from one to many.

    programs: for each language a function from a version and the pieces of a job's JSON input to the pieces of its JSON
    output; one call for each job. Files are sorted by path into the input, which no task holds whole, and every row of
    output is a JSON object with some of what the output's members hold, as output_tables takes it. parallel as in
    run_jobs.
    """
    key = ["language", "version", "profile"]
    file = F.to_json(F.create_map("path", F.struct("content")))
    jobs = jobs.withColumn("job_id", F.md5(F.concat_ws("\x00", *key)))
    rows = jobs.join(sources.select("path", "content"), "path").select("job_id", "language", "version", "path", F.substring(file, F.lit(2), F.length(file) - 2).alias("file"))

    def pieces(language: str, files: Iterator[tuple]) -> Iterator[str]:
        yield f'{{"language":{json.dumps(language)},"sources":{{'
        last = None
        for *_, path, text in files:
            if path == last:
                raise ValueError(f"{path} is in one job twice")
            yield text if last is None else "," + text
            last = path
        yield f'}},"settings":{settings}}}'

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch = lambda job, v, found: pa.RecordBatch.from_arrays([pa.array([job] * len(found)), pa.array([v] * len(found)), pa.array(found)], ["job_id", "version", "output"])
        files = (r for b in batches for r in zip(*[c.to_pylist() for c in b.columns], strict=True))
        for (job, language, v), own in groupby(files, lambda r: r[:3]):
            if language not in programs:
                raise ValueError(f"no compiler for {language}")
            found, n = [], 0
            for part in json_parts.parts(programs[language](v, pieces(language, own))):
                found.append(part)
                n += len(part)
                if n >= 1 << 20:
                    yield batch(job, v, found)
                    found, n = [], 0
            if found:
                yield batch(job, v, found)

    dealt = rows.repartition("job_id") if parallel is None else rows.join(F.broadcast(_dealt(jobs, parallel)), "job_id").repartitionById(parallel, "task").select(*rows.columns)
    return dealt.sortWithinPartitions("job_id", "path").mapInArrow(run, "job_id string, version string, output string")


_OUTPUT = (
    "errors array<struct<severity: string, errorCode: string, message: string, formattedMessage: string, sourceLocation: struct<file: string, start: bigint, `end`: bigint>>>, "
    "contracts map<string, map<string, string>>, sources map<string, string>"
)


def output_tables(outputs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Diagnostics, contracts and sources of outputs (job_id, version, output), whole ones or in parts.

    contracts: job_id, version, path, name, abi, bytecode, deployed, metadata; sources: job_id, version, path,
    source_id, ast (JSON text).
    """
    rows = outputs.withColumn("o", F.from_json("output", _OUTPUT))
    d = rows.select("job_id", "version", F.explode("o.errors").alias("e"))
    diagnostics = d.select("job_id", "version", "e.severity", F.col("e.errorCode").try_cast("bigint").alias("error_code"), F.col("e.sourceLocation.file").alias("file"), F.col("e.sourceLocation.start").alias("start"), F.col("e.sourceLocation.end").alias("end"), "e.message")
    c = rows.select("job_id", "version", F.explode("o.contracts").alias("path", "by_name")).select("job_id", "version", "path", F.explode("by_name").alias("name", "c"))
    part = lambda p: F.get_json_object("c", f"$.{p}")
    contracts = c.select("job_id", "version", "path", "name", part("abi").alias("abi"), part("evm.bytecode.object").alias("bytecode"), part("evm.deployedBytecode.object").alias("deployed"), part("metadata").alias("metadata"))
    s = rows.select("job_id", "version", F.explode("o.sources").alias("path", "s"))
    sources = s.select("job_id", "version", "path", F.get_json_object("s", "$.id").cast("bigint").alias("source_id"), F.get_json_object("s", "$.ast").alias("ast"))
    return diagnostics, contracts, sources


def compile_files(sources: DataFrame, project: Project, installed: DataFrame, compile_one: Callable[[str, str], str], settings: dict | None = None, entries: DataFrame | None = None, artifacts: DataFrame | None = None, out: str | None = None, dumps: bool = False, preprocess: Callable[[DataFrame], DataFrame] | None = None) -> dict[str, DataFrame]:
    """The whole way: parse, resolve, solve, drop what is clean, run, and read the outputs as tables.

    preprocess: a function from sources (path, content) to sources, before compiling. artifacts: the cached ones (path,
    name, version, profile, artifact_path, build_id), whose paths stay. out: a folder for the artifacts as JSON, for the
    cache (Parquet, below cache), and with dumps for all inputs and outputs.
    """
    parsed = Written(parsed_sources(sources), "parsed").df
    edges, missing = import_graph(parsed, project)
    jobs = plan_jobs(parsed, edges, installed, project, entries)
    need = incremental.job_kinds(parsed.select("path"), jobs.where("dirty").select("path"), edges)
    texts = parsed.select("path", "content")
    inputs = Written(job_inputs(jobs.join(need.select("path"), "path", "left_semi"), preprocess(texts) if preprocess else texts, json.dumps(settings or {})), "inputs").df
    done = Written(run_jobs(inputs, compile_one), "outputs").df
    diagnostics, contracts, out_sources = output_tables(done)
    found = {"jobs": jobs, "unresolved": missing, "diagnostics": diagnostics, "contracts": contracts, "sources": out_sources}
    if out is None:
        return found
    none = "path string, name string, version string, profile string, artifact_path string, build_id string"
    old = parsed.sparkSession.createDataFrame([], none) if artifacts is None else artifacts
    made = contracts.join(inputs.select("job_id", "profile"), "job_id").dropDuplicates(incremental.KEY)
    placed = outputs.artifact_paths(made.select(*incremental.KEY), old.select(*incremental.KEY, "artifact_path"), project.profile)
    made = Written(made.join(placed, incremental.KEY), "made").df
    files = sinks.artifact_json(made, ["abi", "bytecode", "deployed", "metadata"])
    if dumps:
        files = files.unionByName(job_dumps(inputs, "input", "input")).unionByName(job_dumps(done, "output", "output"))
    Written(sinks.write_files(files, out), "files")
    fresh = made.select(*incremental.KEY, F.col("file").alias("artifact_path"), F.col("job_id").alias("build_id"))
    kept = incremental.upsert(old.select(*fresh.columns), fresh)
    now = incremental.cache_entry_rows(texts.withColumns({"mtime_ms": F.lit(None).cast("long"), "version_text": F.lit(None).cast("string")}), edges)
    sinks.write_cache(now, kept, kept.select("build_id").distinct(), f"{out}/cache")
    return found | {"artifacts": kept}

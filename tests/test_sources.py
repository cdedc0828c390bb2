import json
import os
import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from buildlens.operators import graph, resolve
from buildlens.plans import planner
from buildlens.sources import remappings, scan, sinks
from buildlens.streaming import watch


def tree(root, files):
    for name, text in files.items():
        path = os.path.join(root, name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "w", newline="") as f:
            f.write(text)


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_scan(spark, tmp_path):
    root = str(tmp_path)
    tree(root, {"src/A.sol": "a\r\nb\rc", "src/sub/B.yul": "b", "src/C.txt": "no", "test/T.t.sol": "t"})
    assert rows(scan.source_files(spark, root), "path", "content") == [("src/A.sol", "a\nb\rc"), ("src/sub/B.yul", "b"), ("test/T.t.sol", "t")]
    assert rows(scan.source_listing(spark, root), "path", "length") == [("src/A.sol", 6), ("src/sub/B.yul", 1), ("test/T.t.sol", 1)]
    assert rows(scan.source_dirs(scan.source_files(spark, root)), "path") == [("src",), ("src/sub",), ("test",)]
    kinds = scan.project_inputs(spark, {"source": f"{root}/src", "test": f"{root}/test", "script": f"{root}/none"})
    assert sorted(r["kind"] for r in kinds.collect()) == ["source", "source", "test"]


def test_listing_helpers(spark):
    names = spark.createDataFrame([("0.8.10",), ("0.8.9",), ("x",), ("0.8.9",)], "name string")
    assert [r["v"] for r in scan.installed_versions(names).collect()] == [[0, 8, 9], [0, 8, 10]]
    listing = spark.createDataFrame([("src/Abc.sol",), ("src/d.sol",)], "path string")
    wanted = spark.createDataFrame([("src/abc.sol",), ("src/d.sol",), ("src/no.sol",)], "path string")
    assert rows(scan.read_errors(wanted, listing), "path", "error") == [("src/abc.sol", "wrong case: src/Abc.sol"), ("src/d.sol", None), ("src/no.sol", "missing")]


def test_cache_round_trip(spark, tmp_path):
    cache = {"_format": "x-4", "builds": ["b1"], "files": {"src/A.sol": {"lastModificationDate": 5, "contentHash": "h", "sourceName": "src/A.sol", "imports": ["i"], "versionRequirement": "^0.8", "artifacts": {"A": {"0.8.1": {"default": {"path": "A.sol/A.json", "build_id": "b1"}}}}, "seenByCompiler": True}}}
    (tmp_path / "cache.json").write_text(json.dumps(cache))
    entries, artifacts, builds = scan.read_cache(spark, str(tmp_path / "cache.json"), "/root")
    assert rows(entries, "path", "mtime_ms", "content_hash", "seen") == [("/root/src/A.sol", 5, "h", True)]
    assert rows(artifacts, "path", "name", "version", "profile", "artifact_path", "build_id") == [("/root/src/A.sol", "A", "0.8.1", "default", "/root/A.sol/A.json", "b1")]
    assert rows(builds, "build_id") == [("b1",)]
    sinks.write_cache(entries, artifacts, builds, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out" / "artifacts")).count() == 1


def test_one_cache_file_round_trip(spark, tmp_path):
    entries = spark.createDataFrame([("a.sol", 5, "h", None, "a.sol", ["b.sol"], "^0.8", True), ("b.sol", None, None, None, None, [], None, False)], "path string, mtime_ms long, content_hash string, interface_hash string, source_name string, imports array<string>, version_text string, seen boolean")
    keys = [("a.sol", "A", "0.8.1", "default", "A.json", "b1"), ("a.sol", "A", "0.8.1", "fast", "A.fast.json", "b2"), ("a.sol", "A", "0.8.2", "default", "A.2.json", None), ("a.sol", "C", "0.8.1", "default", "C.json", "b1")]
    artifacts = spark.createDataFrame(keys, "path string, name string, version string, profile string, artifact_path string, build_id string")
    builds = spark.createDataFrame([("b2",), ("b1",), ("b1",)], "build_id string")
    assert sinks.write_files(sinks.cache_json(entries, artifacts, builds, "x-4"), f"file://{tmp_path}").count() == 1
    file = json.loads((tmp_path / "cache.json").read_text())
    assert (file["_format"], file["builds"], file["files"]["b.sol"]["artifacts"]) == ("x-4", ["b1", "b2"], {})
    again = scan.read_cache(spark, str(tmp_path / "cache.json"))
    for had, has in zip((entries, artifacts, builds.distinct()), again, strict=True):
        assert rows(has, *had.columns) == rows(had, *had.columns)
    empty = sinks.cache_json(entries.limit(0), artifacts.limit(0), builds.limit(0), "x-4").collect()
    assert json.loads(empty[0]["content"]) == {"_format": "x-4", "files": {}, "builds": []}


def test_builds_are_read_by_id(spark):
    listing = spark.createDataFrame([("out/b1.json", '{"id": 1}'), ("out/b2.json", "{"), ("out/other.json", '{"id": 9}'), ("out/b1.txt", "x")], "path string, content string")
    wanted = spark.createDataFrame([("b1",), ("b1",), ("b2",), ("b3",)], "build_id string")
    got = scan.read_builds(listing, wanted, "id long")
    assert rows(got, "build_id", "build.id", "error") == [("b1", 1, None), ("b2", None, "unreadable"), ("b3", None, "missing")]


def test_sinks(spark, tmp_path):
    a = spark.createDataFrame([("A.sol/A.json", "[]", "ir!", None)], "file string, abi string, ir string, metadata string")
    out = f"file://{tmp_path}/out"
    assert rows(sinks.write_files(sinks.artifact_json(a, ["abi", "ir"]), out), "path", "bytes") == [("A.sol/A.json", 23)]
    assert json.loads((tmp_path / "out/A.sol/A.json").read_text()) == {"abi": "[]", "ir": "ir!"}
    assert rows(sinks.extra_files(a, {"ir": "ir", "metadata": "metadata.json"}), "path", "content") == [("A.sol/A.ir", "ir!")]
    assert rows(scan.read_artifacts(spark, [str(tmp_path / "out/A.sol/A.json")], "abi string"), "abi") == [("[]",)]
    sinks.cleanup(spark, [out], f"file://{tmp_path}")
    assert not (tmp_path / "out").exists()
    with pytest.raises(ValueError, match="root"):
        sinks.cleanup(spark, [f"file://{tmp_path}"], f"file://{tmp_path}/project")


def test_remapping_discovery(spark):
    files = ["lib/ds/src/a.sol", "lib/ds/src/x/b.sol", "lib/oz/contracts/token/c.sol", "lib/oz/lib/inner/src/d.sol", "lib/plain/e.sol", "lib/ds/test/t.sol", "lib/.git/f.sol", "lib/oz/node_modules/@n/g.sol", "src/own.sol"]
    found = dict(rows(remappings.find_remappings(spark.createDataFrame([(f,) for f in files], "path string"), "lib"), "name", "path"))
    assert found == {"ds/": "lib/ds/src/", "oz/": "lib/oz/contracts/", "inner/": "lib/oz/lib/inner/src/", "plain/": "lib/plain/", "@n/": "lib/oz/node_modules/@n/"}


def compiler():
    """A function without a module, so that executors needn't import this file."""

    def fake_compiler(version: str, text: str) -> str:
        sources = json.loads(text)["sources"]
        contracts = {p: {n: {"abi": [], "evm": {"bytecode": {"object": "60"}}} for n in re.findall(r"contract (\w+)", s["content"])} for p, s in sources.items()}
        errors = [{"severity": "warning", "errorCode": "1878", "message": version, "sourceLocation": {"file": p, "start": 0, "end": 1}} for p in sources]
        return json.dumps({"contracts": contracts, "sources": {p: {"id": i} for i, p in enumerate(sources)}, "errors": errors})

    return fake_compiler


def test_whole_way(spark):
    data = [("src/A.sol", "pragma solidity ^0.8.0;\nimport './B.sol';\ncontract A {}"), ("src/B.sol", "pragma solidity >=0.7.0;\ncontract B {}"), ("src/C.sol", "pragma solidity 0.7.6;\nimport 'x/No.sol';\ncontract C {}")]
    sources = spark.createDataFrame(data, "path string, content string")
    installed = spark.createDataFrame([([0, 7, 6],), ([0, 8, 4],)], "v array<int>")
    out = planner.compile_files(sources, planner.Project(), installed, compiler())
    assert rows(out["jobs"], "version", "path", "is_input") == [("0.7.6", "src/C.sol", True), ("0.8.4", "src/A.sol", True), ("0.8.4", "src/B.sol", True)]
    assert rows(out["unresolved"], "import", "file") == [("x/No.sol", "src/C.sol")]
    assert rows(out["contracts"], "path", "name", "version", "bytecode") == [("src/A.sol", "A", "0.8.4", "60"), ("src/B.sol", "B", "0.8.4", "60"), ("src/C.sol", "C", "0.7.6", "60")]
    assert rows(out["diagnostics"], "error_code", "file") == [(1878, "src/A.sol"), (1878, "src/B.sol"), (1878, "src/C.sol")]
    assert rows(out["sources"], "path", "source_id") == [("src/A.sol", 0), ("src/B.sol", 1), ("src/C.sol", 0)]
    same = sources.select("path", F.md5("content").alias("content_hash"), F.lit(None).cast("string").alias("interface_hash"))
    assert planner.compile_files(sources, planner.Project(), installed, compiler(), entries=same)["contracts"].count() == 0


def test_command_line(spark):
    from buildlens.functions.versions import version

    args = lambda v: spark.range(1).select(planner.command_line(version(*v), F.lit("."), ["inc"], ["a", "b"])).first()[0]
    assert args((0, 6, 8)) == ["--standard-json", "--allow-paths", "a,b"]
    assert args((0, 8, 8)) == ["--standard-json", "--allow-paths", "a,b", "--base-path", ".", "--include-path", "inc"]


def test_run_jobs_fails_whole(spark):
    jobs = spark.createDataFrame([("1", "0.8.0", "x")], "job_id string, version string, input string")

    def broken(version, text):
        raise RuntimeError("compiler broke")

    with pytest.raises(Exception, match="compiler broke"):
        planner.run_jobs(jobs, broken, 1).collect()


def test_random_projects(spark):
    """Imports by pattern lead to the graph that was drawn."""
    import random

    rng = random.Random(5)
    names = [f"src/d{i % 3}/F{i}.sol" for i in range(12)]
    want = {(a, rng.choice(names)) for a in names for _ in range(2)}
    up = lambda a, b: "./" + os.path.relpath(b, os.path.dirname(a))
    text = {a: "".join(f'import "{up(a, b)}";\n' for x, b in sorted(want) if x == a) for a in names}
    parsed = planner.parsed_sources(spark.createDataFrame(list(text.items()), "path string, content string"))
    edges, missing = planner.import_graph(parsed, planner.Project())
    assert rows(edges, "src", "dst") == sorted(want)
    assert missing.count() == 0
    assert rows(graph.importers(edges, parsed.where("endswith(path, 'F0.sol')")), "importer") == sorted((a,) for a, b in want if b == names[0])
    assert resolve.import_rows(parsed).count() == len(want)


def test_stream_of_sources(spark, tmp_path):
    folder = str(tmp_path / "in")
    t = pd.Timestamp("2024-01-01")
    put = lambda data, n: spark.createDataFrame(pd.DataFrame(data, columns=["path", "content", "at"]), "path string, content string, at timestamp").coalesce(1).write.mode("append").parquet(folder)
    put([("a", "1", t), ("b", "1", t)], 0)
    stream = watch.source_stream(spark, folder)
    run = lambda: watch.changed_files(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination(120)
    run()
    put([("a", "1", t), ("b", "2", t + pd.Timedelta("1s")), ("b", "3", t + pd.Timedelta("2s"))], 1)
    run()
    got = rows(spark.read.parquet(str(tmp_path / "out")), "path", "change")
    assert got == [("a", "new"), ("b", "changed"), ("b", "changed"), ("b", "new")]


def test_stream_upsert(spark, tmp_path):
    schema = "path string, name string, version string, profile string, artifact_path string"
    for i, data in enumerate([[("a", "A", "1", "d", "old")], [("a", "A", "1", "d", "new"), ("b", "B", "1", "d", "b")]]):
        spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        watch.upsert_batches(stream, str(tmp_path / "cache"), str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination(120)
        assert rows(spark.read.parquet(str(tmp_path / f"cache/{i}")), "artifact_path") == ([("old",)] if i == 0 else [("b",), ("new",)])

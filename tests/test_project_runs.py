"""Whole runs, names free of conflicts, names outside strings, bounds along edges."""

import json
import sys

import pytest

from buildlens.functions import solidity
from buildlens.operators import graph, outputs, solve
from buildlens.plans import planner
from buildlens.plans.further_queries import _stub
from buildlens.storage import shared_dir


def test_a_new_artifact_does_not_take_a_cached_one_s_file(spark):
    new = spark.createDataFrame([("lib/A.sol", "A", "0.8.0", "default"), ("src/A.sol", "A", "0.8.0", "default"), ("src/B.sol", "B", "0.8.1", "default")], "path string, name string, version string, profile string")
    cached = spark.createDataFrame([("src/A.sol", "A", "0.8.0", "default", "A.sol/A.json"), ("src/B.sol", "B", "0.8.0", "default", "B.sol/B.json"), ("old/x.sol", "A", "0.8.0", "default", "lib/a.sol/A.json")], "path string, name string, version string, profile string, artifact_path string")
    got = {(r["path"], r["version"]): r["file"] for r in outputs.artifact_paths(new, cached).collect()}
    assert got == {("src/A.sol", "0.8.0"): "A.sol/A.json", ("lib/A.sol", "0.8.0"): "A.sol_1/A.json", ("src/B.sol", "0.8.1"): "B.sol/B.0.8.1.json"}


def test_conflicts_go_on_until_names_are_free(spark):
    rows = [("a/x/F.sol", "F.sol/C.json"), ("b/x/f.sol", "f.sol/C.json"), ("c/x/F.sol", "F.sol/C.json"), ("F.sol", "F.sol/C.json"), ("d/F.sol", "F.sol/c.json")]
    taken = spark.createDataFrame([("D/f.sol/c.json",), ("F.sol_1/c.json",)], "file string")
    got = {r["path"]: r["file"] for r in outputs.conflict_free(spark.createDataFrame(rows, "path string, file string"), taken).collect()}
    assert got == {"F.sol": "F.sol/C.json", "d/F.sol": "F.sol_2/c.json", "a/x/F.sol": "x/F.sol/C.json", "b/x/f.sol": "b/x/f.sol/C.json", "c/x/F.sol": "c/x/F.sol/C.json"}
    assert len({f.lower() for f in got.values()}) == len(rows)
    assert outputs.conflict_free(spark.createDataFrame([], "path string, file string")).count() == 0


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ('string s = "T"; T t;', 'string s = "T"; Foo t;'), ("// T\nT.f(); /* T\nT */ T(1)", "// T\nFoo.f(); /* T\nT */ Foo(1)"), ("function T() error T(); import {A as T}", "function T() error T(); import {A as T}"),
        ("a.T xT T_ $T T$", "a.T xT T_ $T T$"), ("is A, T {", "is A, Foo {"), ("'it\\'s T' T \"a\\\"T\" T", "'it\\'s T' Foo \"a\\\"T\" Foo"), ("T / T /", "Foo / Foo /"), ("", ""),
    ],
)
def test_aliases_outside_strings_comments_and_declarations(spark, text, want):
    from pyspark.sql import functions as F

    names = F.array(F.struct(F.lit("T").alias("alias"), F.lit("Foo").alias("target")))
    assert spark.range(1).select(solidity.renamed(F.lit(text), names)).first()[0] == want


def test_bounds_move_along_edges(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "b"), ("d", "a")], "src string, dst string")
    own = spark.createDataFrame([("a", None, 9), ("b", 1, None), ("c", 5, 8), ("d", 2, 7), ("e", None, None)], "path string, lo int, hi int")
    assert {r["path"]: (r["lo"], r["hi"]) for r in graph.spread_bounds(edges, own).collect()} == {"a": (5, 8), "b": (5, 8), "c": (5, 8), "d": (5, 7), "e": (None, None)}
    reqs = spark.createDataFrame([("a", ([0, 8, 0], None)), ("b", ([0, 7, 0], [0, 8, 0])), ("c", None), ("d", None)], "path string, requirement struct<lo: array<int>, hi: array<int>>")
    chosen = spark.createDataFrame([("a", [0, 8, 1]), ("c", [0, 7, 5])], "path string, v array<int>")
    assert {r["path"]: r["ok"] for r in solve.rechecked_versions(chosen, edges, reqs).collect()} == {"a": False, "c": True}


def test_relative_remappings_and_last_steps(spark):
    rules = spark.createDataFrame([(0, "/r/src", "@a/", "/r/lib/a/"), (1, None, "b/", "/other/b/")], "ordinal int, context string, name string, path string")
    assert [(r["context"], r["path"]) for r in graph.relative_remappings(rules, "/r").orderBy("ordinal").collect()] == [("src", "lib/a/"), (None, "/other/b/")]
    rows = spark.createDataFrame([("Vyper", 1), ("Yul", 2), (None, 3)], "language string, n int")
    done = graph.finalize_imports(rows, {"Vyper": lambda df: df.withColumn("n", df["n"] + 10)})
    assert sorted(r["n"] for r in done.collect()) == [2, 3, 11]


def test_compilers_by_language_and_their_versions(tmp_path):
    one = planner.by_language({"Solidity": lambda v, _: v})
    assert one("0.8.0", json.dumps({"language": "Solidity"})) == "0.8.0"
    with pytest.raises(ValueError, match="no compiler for Vyper"):
        one("0.3.0", json.dumps({"language": "Vyper"}))
    count = tmp_path / "count"
    script = f"import pathlib; p = pathlib.Path({str(count)!r}); p.write_text(p.read_text() + 'x' if p.exists() else 'x'); print('name'); print('Version: 0.8.1+c.Linux.g++')"
    for _ in range(2):
        assert planner.program_version(sys.executable, ("-c", script)) == "0.8.1+c.Linux.gcc"
    assert count.read_text() == "x"
    echo = tmp_path / "vyper.py"
    echo.write_text(f"#!{sys.executable}\nimport sys\nassert sys.argv[1:] == ['--standard-json']\nprint(sys.stdin.read().upper(), end='')\n")
    echo.chmod(0o755)
    assert planner.vyper_process(str(echo))("0.3.0", '{"a": 1}') == '{"A": 1}'


def test_a_whole_run_writes_artifacts_cache_and_dumps(spark):
    content = "pragma solidity ^0.8.0;\ncontract A {}\n"
    sources = spark.createDataFrame([("src/A.sol", content), ("lib/A.sol", content)], "path string, content string")
    installed = spark.createDataFrame([([0, 8, 0],), ([0, 7, 0],)], "v array<int>")
    root = f"{shared_dir(spark)}/run"
    cached = spark.createDataFrame([("old/A.sol", f"C{len(content) + 1}", "0.8.0", "default", f"A.sol/C{len(content) + 1}.json", "b0")], "path string, name string, version string, profile string, artifact_path string, build_id string")
    seen = []

    def note(df):
        seen.append(df.columns)
        return df

    got = planner.compile_files(sources, planner.Project(), installed, planner.by_language({"Solidity": _stub}), artifacts=cached, out=root, dumps=True, preprocess=note)
    assert seen == [["path", "content"]]
    kept = {(r["path"], r["artifact_path"]) for r in spark.read.parquet(f"{root}/cache/artifacts").collect()}
    name = f"C{len(content)}.json"
    assert kept == {("old/A.sol", f"A.sol/C{len(content) + 1}.json"), ("lib/A.sol", f"A.sol/{name}"), ("src/A.sol", f"src/A.sol/{name}")}
    text = spark.read.text(f"{root}/src/A.sol/{name}", wholetext=True).first()[0]
    assert json.loads(text)["bytecode"] == "600"
    assert sorted(r["path"] for r in spark.read.parquet(f"{root}/cache/entries").collect()) == ["lib/A.sol", "src/A.sol"]
    assert spark.read.text(f"{root}/input.0.8.0.*.json", wholetext=True).count() == 1
    assert spark.read.text(f"{root}/output.0.8.0.*.json", wholetext=True).count() == 1
    assert got["diagnostics"].count() == 2

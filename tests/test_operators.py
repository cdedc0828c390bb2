import json
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from buildlens.operators import ast, edits, filters, graph, incremental, outputs, resolve, solve, sourcemap


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def frame(spark, data, schema):
    return spark.createDataFrame(data, schema)


# Diagnostics and selections


def test_ignored_and_has_error(spark):
    data = [
        (1, "warning", 1878, "a.t.sol"), (2, "warning", 1878, "a.sol"), (3, "warning", None, "lib/a.sol"), (4, "warning", 7, "lib/a.sol"), (5, "warning", 7, "library/a.sol"),
        (6, "error", 1878, "lib/a.sol"), (7, "info", 1878, "a.t.sol"), (8, "warning", 9, None), (9, "warning", 5, "gen/x.sol"), (10, "warning", 6, "gen/x.sol"), (11, "warning", 1878, "spec.sol"),
    ]
    d = frame(spark, data, "id int, severity string, error_code long, file string")
    judged = filters.ignored(d, [9], ["lib/"], [("gen", [5])], frame(spark, [("spec.sol",)], "path string"))
    assert [r[0] for r in rows(judged.where("ignored"), "id")] == [1, 11, 4, 8, 9]
    flags = lambda df, f: tuple(filters.has_error(df, f).first())
    assert flags(judged, "error") == (True, True)
    quiet = judged.where("id in (1, 4)")
    assert flags(quiet, "warning") == (False, False)
    assert flags(judged.where("id in (1, 7)"), "warning") == (True, True)  # infos aren't ignored
    assert flags(judged.where("id = 2"), "error") == (False, True)
    assert flags(judged.where("id = 7"), "info") == (True, True)
    assert flags(judged.limit(0), "warning") == (False, False)


def test_sparse_and_retain(spark):
    jobs = frame(spark, [("j", "a", True, True), ("j", "b", True, False), ("j", "c", False, True), ("j", "d", False, False)], "job_id string, path string, dirty boolean, matches boolean")
    need = frame(spark, [("j", "d"), ("j", "d")], "job_id string, path string")
    assert rows(filters.sparse_outputs(jobs, need, False).where("selected"), "path") == [("a",), ("d",)]
    assert filters.sparse_outputs(jobs, need, True).where("selected").count() == 4
    assert rows(filters.retain_files(frame(spark, [("A.sol",), ("b.sol",)], "path string"), frame(spark, [("a.SOL",)], "path string")), "path") == [("A.sol",)]


def test_selections(spark):
    df = frame(spark, [({"a": {"": ["ast"]}}, {"a": {"": ["ast", "abi"]}}), ({"a": {"X": ["abi"]}}, {"a": {"Y": ["abi"]}}), ({"b": {}}, {"a": {}}), ({"*": {"*": ["abi"]}}, {"*": {"*": ["abi"]}})], "x map<string,map<string,array<string>>>, y map<string,map<string,array<string>>>")
    got = df.select(filters.is_subset(F.col("x"), F.col("y")).alias("s"), filters.contains_ast(F.col("x")).alias("t")).collect()
    assert [tuple(r) for r in got] == [(True, True), (False, False), (False, False), (True, False)]
    tree = F.parse_json(F.lit('{"nodes":[{"nodeType":"PragmaDirective"},{"nodeType":"ContractDefinition"}]}'))
    assert spark.range(1).select(filters.contains_contract_definition(tree)).first()[0]


def test_settings_restrictions(spark):
    r = F.struct(F.lit(3).alias("evm_min"), F.lit(None).cast("int").alias("evm_max"), F.lit(True).alias("via_ir"), F.lit(1).alias("runs_min"), F.lit(None).cast("int").alias("runs_max"), F.lit(None).cast("string").alias("bytecode_hash"))
    ask = lambda evm, ir, runs, opt: spark.range(1).select(filters.satisfies_restrictions(F.lit(evm), F.lit(ir), F.lit(runs), F.lit(opt), F.lit("ipfs"), r)).first()[0]
    assert ask(4, True, 200, True)
    assert not ask(2, True, 200, True)
    assert not ask(4, False, 200, True)
    assert not ask(4, True, 200, False)


# Imports


def test_resolution_cascade(spark):
    listing = frame(spark, [(p,) for p in ["src/a/X.sol", "src/b/Y.sol", "lib/t/src/T.sol", "lib/u/U.sol", "map/M.sol", "over/b/Y.sol", "lib/oz/contracts/token/E.sol", "lib/n/contracts/N.sol", "lib/n/contracts/deep/P.sol", "src/Z.sol"]], "path string")
    rules = frame(spark, [(0, None, "m/", "map/"), (1, "src/q", "src/b", "over/b"), (2, None, "@oz/", "lib/oz/contracts/")], "ordinal int, context string, name string, path string")
    libs = frame(spark, [(0, "lib")], "ordinal int, path string")
    want = {
        "rel": ("src/a", "../b/Y.sol", "src/b/Y.sol", "relative"), "redirected": ("src/q", "./../b/Y.sol", "over/b/Y.sol", "relative"), "gone": ("src/a", "./No.sol", None, None), "map": ("src", "m/M.sol", "map/M.sol", "remapping"),
        "twice": ("src", "@oz/contracts/token/E.sol", "lib/oz/contracts/token/E.sol", "remapping"), "lib": ("src", "u/U.sol", "lib/u/U.sol", "library"), "libsrc": ("src", "t/T.sol", "lib/t/src/T.sol", "library"),
        "nested": ("lib/n/contracts/deep", "contracts/N.sol", "lib/n/contracts/N.sol", "nested"), "root": ("src", "Z.sol", "src/Z.sol", "fallback"), "no": ("src", "q/Q.sol", None, None),
    }
    imports = frame(spark, [(k, a, b) for k, (a, b, _, _) in want.items()], "id string, cwd string, import string")
    got = {r["id"]: (r["path"], r["how"]) for r in resolve.resolve_imports(imports, rules, libs, listing, ["", "src"]).collect()}
    assert got == {k: (p, h) for k, (_, _, p, h) in want.items()}


def test_first_remapping_wins(spark):
    rules = frame(spark, [(1, None, "a/", "late/"), (0, None, "a/b/", "early/"), (2, None, "one.sol", "two.sol")], "ordinal int, context string, name string, path string")
    imports = frame(spark, [("1", "", "a/b/c.sol"), ("2", "", "ab/c.sol"), ("3", "", "one.sol"), ("4", "", "a/c.sol")], "id string, cwd string, import string")
    assert rows(resolve.remapped(imports, rules, imports.select(F.col("import").alias("path")).limit(0)), "id", "path") == [("1", "early/c.sol"), ("3", "two.sol"), ("4", "late/c.sol")]


def test_vyper_imports(spark):
    listing = frame(spark, [("p/a.vy",), ("p/q/b.vyi",), ("x/y.vy",), ("lib/z.vy",)], "path string")
    libs = frame(spark, [(0, "lib")], "ordinal int, path string")
    i = frame(spark, [(1, "p/q/m.vy", 1, "b"), (2, "p/q/m.vy", 2, "a"), (3, "p/q/m.vy", 0, "x.y"), (4, "p/q/m.vy", 0, "z"), (5, "p/q/m.vy", 0, "none")], "id int, file string, level int, path string")
    assert rows(resolve.resolve_vyper(i, listing, libs), "id", "path") == [(1, "p/q/b.vyi"), (2, "p/a.vy"), (3, "x/y.vy"), (4, "lib/z.vy"), (5, None)]


# Graphs


def reach(edges, start, with_self):
    seen, todo = ({start} if with_self else set()), [start]
    while todo:
        for b in edges.get(todo.pop(), ()):
            if b not in seen:
                seen.add(b)
                todo.append(b)
    return seen


def test_closures_on_random_graphs(spark):
    rng = random.Random(3)
    pairs = [(f"n{rng.randrange(25)}", f"n{rng.randrange(25)}") for _ in range(40)]
    by = {}
    for a, b in pairs:
        by.setdefault(a, set()).add(b)
    edges = frame(spark, pairs, "src string, dst string")
    files = frame(spark, [(f"n{i}",) for i in range(25)], "path string")
    for include in (True, False):
        got = rows(graph.closure(edges, files.select(F.col("path").alias("root")), include), "root", "node")
        assert got == sorted([(f"n{i}", x) for i in range(25) for x in reach(by, f"n{i}", include)], key=str)
    back = {}
    for a, b in pairs:
        back.setdefault(b, set()).add(a)
    dirty = rows(graph.dirty_files(edges, frame(spark, [("n3",), ("n7",)], "path string")), "path")
    assert dirty == sorted([(x,) for x in reach(back, "n3", True) | reach(back, "n7", True)])
    targets = frame(spark, [("n1",), ("n2",)], "path string")
    order = {}
    for r in graph.ordered_dependencies(edges, targets).orderBy("place").collect():
        order.setdefault(r["target"], []).append(r["path"])
    for t in ("n1", "n2"):
        assert order[t] == sorted(reach(by, t, True), key=lambda n: (n == t, len(reach(by, n, True)), n))


def test_empty_graph(spark):
    edges = frame(spark, [], "src string, dst string")
    assert rows(graph.closure(edges, frame(spark, [("a",)], "root string")), "root", "node", "depth") == [("a", "a", 0)]
    assert graph.dirty_files(edges, frame(spark, [], "path string")).count() == 0


def test_recompute_unchanged_and_modified(spark):
    edges = frame(spark, [("a", "b"), ("b", "c"), ("d", "c"), ("e", "e2")], "src string, dst string")
    sources = incremental.hashed(frame(spark, [(p, p * 3) for p in ["a", "b", "c", "d", "e", "e2"]], "path string, content string")).withColumn("interface_hash", F.lit(None).cast("string"))
    entries = sources.select("path", "content_hash", "interface_hash")
    assert incremental.dirty_sources(sources, entries, edges).count() == 0
    changed = sources.withColumn("content_hash", F.when(F.col("path") == "b", "new").otherwise(F.col("content_hash")))
    assert rows(incremental.dirty_sources(changed, entries, edges), "path") == [("a",), ("b",)]


def test_interface_dirtiness(spark):
    s = frame(spark, [("t", "test", False, False), ("s", "source", True, False), ("s2", "source", False, False), ("m", "mock", False, False)], "path string, kind string, changed boolean, interface_changed boolean")
    edges = frame(spark, [("t", "s"), ("s2", "s"), ("m", "s")], "src string, dst string")
    assert rows(graph.dirty_by_interface(s, edges), "path") == [("s",), ("s2",)]
    loud = s.withColumn("interface_changed", F.col("path") == "s")
    assert rows(graph.dirty_by_interface(loud, edges), "path") == [("m",), ("s",), ("s2",), ("t",)]


# Solving


def test_solving(spark):
    from buildlens.functions.versions import parse_requirement

    v = solve.available_versions(frame(spark, [([0, 7, 6],), ([0, 8, 4],), ([0, 8, 19],)], "v array<int>"), frame(spark, [([0, 8, 25],), ([0, 8, 4],)], "v array<int>"))
    assert v.count() == 4
    req = frame(spark, [("a", "^0.8.0"), ("b", ">=0.7.0 <0.8.10"), ("c", "0.7.6"), ("d", None), ("x", "0.8.25"), ("y", "0.7.6")], "path string, t string").select("path", parse_requirement(F.col("t")).alias("requirement"))
    edges = frame(spark, [("a", "b"), ("x", "y")], "src string, dst string")
    ask = lambda *names: rows(solve.chosen_versions(solve.compatible_versions(req, edges, frame(spark, [(n,) for n in names], "path string"), v)), "path", "v")
    assert ask("a", "d") == [("a", [0, 8, 4]), ("d", [0, 8, 4])]  # one version for all
    assert ask("d") == [("d", [0, 8, 19])]  # installed before remote
    assert ask("a", "c", "d") == [("a", [0, 8, 4]), ("c", [0, 7, 6]), ("d", [0, 8, 4])]  # in turn, chosen ones first
    none = solve.compatible_versions(req, edges, frame(spark, [("x",)], "path string"), v)
    assert none.first()["candidates"] == []
    assert rows(solve.conflicts(req, edges, none), "path", "first", "second") == [("x", "x", "y")]
    assert rows(solve.check_available(req, v).where("not ok"), "path") == []


def test_profiles(spark):
    profiles = frame(spark, [(0, "default", 12, False, 200, True), (1, "ir", 12, True, 200, True), (2, "old", 5, False, 0, False)], "ordinal int, profile string, evm int, via_ir boolean, runs int, optimizer boolean")
    r = frame(spark, [("a", None, None, True, None, None), ("b", None, 6, None, None, None), ("c", None, None, False, None, None)], "path string, evm_min int, evm_max int, via_ir boolean, runs_min int, runs_max int")
    edges = frame(spark, [("d", "a"), ("e", "a"), ("e", "c")], "src string, dst string")
    inputs = frame(spark, [(x,) for x in "abdef"], "path string")
    assert rows(solve.compatible_profiles(r, edges, inputs, profiles), "path", "profile") == [("a", "ir"), ("b", "old"), ("d", "ir"), ("f", "default")]


# Cache


def test_cache_upkeep(spark):
    arts = frame(spark, [("a", "A", "1", "p", "o/a", "b1"), ("a", "A", "2", "p", "o/a2", "b2"), ("b", "B", "1", "q", "o/b", "b3")], "path string, name string, version string, profile string, artifact_path string, build_id string")
    entries = frame(spark, [("a",), ("b",), ("c",)], "path string")
    kept, left = incremental.drop_profiles(arts, entries, frame(spark, [("p", True), ("q", False)], "profile string, keep boolean"))
    assert kept.count() == 2
    assert rows(left, "path") == [("a",), ("c",)]
    new = frame(spark, [("a", "A", "1", "p", "o/new", "b9")], arts.schema)
    assert rows(incremental.upsert(arts, new), "artifact_path") == [("o/a2",), ("o/b",), ("o/new",)]
    assert rows(incremental.unused_builds(frame(spark, [("b1",), ("b7",)], "build_id string"), arts), "build_id") == [("b7",)]
    assert rows(incremental.existing_entries(entries, frame(spark, [("a",)], "path string")), "path") == [("a",)]
    judged = incremental.reusable_profiles(frame(spark, [("p", 1), ("q", 1), ("r", 1)], "profile string, runs int"), frame(spark, [("p", 1), ("q", 2)], "profile string, runs int"), ["runs"])
    assert rows(judged, "profile", "keep") == [("p", True), ("q", False), ("r", False)]
    lacks = spark.range(1).select(incremental.artifact_lacks_output(F.array(F.lit("ir")), F.array(F.lit("abi"))), incremental.artifact_lacks_output(F.array(F.lit("generatedSources")), F.array(F.lit("generatedSources")))).first()
    assert tuple(lacks) == (True, True)
    kinds = incremental.job_kinds(frame(spark, [(x,) for x in "abcd"], "path string"), frame(spark, [("a",)], "path string"), frame(spark, [("a", "b"), ("b", "c"), ("d", "a")], "src string, dst string"))
    assert rows(kinds, "path", "kind") == [("a", "Complete"), ("b", "Optimized"), ("c", "Optimized")]
    e = incremental.cache_entry_rows(frame(spark, [("a", "x", 5, "^0.8")], "path string, content string, mtime_ms long, version_text string"), frame(spark, [("a", "c"), ("a", "b"), ("a", "b")], "src string, dst string"))
    assert e.first()["imports"] == ["b", "c"]
    assert incremental.mark_seen(frame(spark, [("a", False)], "path string, seen boolean"), frame(spark, [("a",)], "path string")).first()["seen"]


# Outputs


def test_lookup_and_unnesting(spark):
    data = [Row(artifacts={"a.sol": {"A": [Row(version="1", profile="d", artifact="x"), Row(version="2", profile="d", artifact="y")]}, "b.sol": {"A": [Row(version="1", profile="d", artifact="z")]}})]
    got = outputs.explode_artifacts(frame(spark, data, "artifacts map<string,map<string,array<struct<version:string,profile:string,artifact:string>>>>"))
    assert rows(got, "path", "version", "artifact") == [("a.sol", "1", "x"), ("a.sol", "2", "y"), ("b.sol", "1", "z")]
    assert outputs.find(got, "A").first()["artifact"] == "x"
    assert outputs.find(got, "A", "b.sol").first()["artifact"] == "z"
    assert outputs.find(got, "none").count() == 0
    one, rest = outputs.take(got, "A", "a.sol")
    assert (one.first()["artifact"], rest.count()) == ("x", 2)
    assert outputs.first_by_name(got).first()["artifact"] == "x"
    fresh = got.where("version = '2'")
    assert rows(outputs.fresh_first(fresh, got, ["name"]), "artifact", "origin") == [("y", "fresh")]
    assert rows(outputs.last_wins([got.where("version = '1'"), fresh.withColumn("path", F.lit("b.sol"))], ["path", "name"]), "path", "artifact") == [("a.sol", "x"), ("b.sol", "y")]
    assert outputs.aggregated([got, fresh], ["path", "name"], ["version"]).where("path = 'a.sol'").first()["versions"][0]["version"] == "1"
    assert outputs.combined(got, fresh).count() == 4


def test_conflict_free_files(spark):
    data = [("src/A.sol", "A.sol/A.json"), ("lib/a.sol", "a.sol/A.json"), ("lib/x/A.sol", "A.sol/A.json"), ("b/B.sol", "B.sol/B.json"), ("dep/lib/x/A.sol", "A.sol/A.json")]
    got = {r["path"]: r["file"] for r in outputs.conflict_free(frame(spark, data, "path string, file string")).collect()}
    assert got["lib/a.sol"] == "a.sol/A.json"
    assert got["src/A.sol"] == "src/A.sol/A.json"
    assert got["b/B.sol"] == "B.sol/B.json"
    assert len({f.lower() for f in got.values()}) == len(data)


def test_artifact_paths(spark):
    c = frame(spark, [("s/A.sol", "A", "1", "default"), ("s/A.sol", "A", "2", "default"), ("s/A.sol", "A", "2", "ir"), ("s/B.sol", "B", "1", "default")], "path string, name string, version string, profile string")
    cached = frame(spark, [("s/B.sol", "B", "1", "default", "old/B.json")], "path string, name string, version string, profile string, artifact_path string")
    assert rows(outputs.artifact_paths(c, cached), "file") == [("A.sol/A.1.json",), ("A.sol/A.2.ir.json",), ("A.sol/A.2.json",), ("old/B.json",)]


def test_groups(spark):
    s = frame(spark, [("a/b/c",), ("a/b/d/e",), ("a/b",)], "path string")
    assert outputs.common_ancestor_all(s).first()["ancestor"] == "a/b"
    assert outputs.common_ancestor_all(frame(spark, [("a/bc",), ("a/b",)], "path string")).first()["ancestor"] == "a"
    b = outputs.build_sources(frame(spark, [("b", 1, "x"), ("b", 0, "y"), ("b", 2, "gone")], "build_id string, source_id long, path string"), frame(spark, [("x",), ("y",)], "path string"))
    assert b.first()["source_id_to_path"] == {0: "y", 1: "x"}
    alone = outputs.standalone_sources(frame(spark, [("a", "1", True), ("b", "1", True), ("c", "1", False)], "path string, version string, has_ast boolean"), frame(spark, [("a", "1")], "path string, version string"))
    assert rows(alone, "path") == [("b",)]


# Source maps, trees, edits


def expand(text):
    out, last = [], [0, 0, -1, "i", 0]
    for part in text.split(";"):
        f = (part.split(":") + [""] * 5)[:5]
        now = [last[i] if x == "" else x if i == 3 else int(x) for i, x in enumerate(f)]
        last = [max(0, now[0]), max(0, now[1]), now[2], now[3], max(0, now[4])]
        out.append((last[0], last[1], None if last[2] == -1 else last[2], last[3], last[4]))
    return out


@pytest.mark.parametrize("text", ["1:2:3:-:4", "1:2:1;1:9;2:1:2;2:1:2;2:1:2", ":::o;;5::-1", "-1:-1:-1:i:-1;3", ";;", "4294967295:1"])
def test_source_map(spark, text):
    df = sourcemap.decode(frame(spark, [("m", text)], "id string, source_map string"))
    got = [tuple(r)[2:] for r in df.orderBy("pos").collect()]
    assert got == expand(text)
    again = sourcemap.encode(df).first()["source_map"]
    assert expand(again) == expand(text)


@pytest.mark.parametrize("text", ["a:1", "1:2:3:q", "-2:1", "4294967296:1"])
def test_source_map_errors(spark, text):
    with pytest.raises(Exception, match="source map"):
        sourcemap.decode(frame(spark, [("m", text)], "id string, source_map string")).collect()


def test_source_map_packing_and_forms(spark):
    x = sourcemap.packed(F.lit("-"), F.lit(77).cast("long"))
    assert tuple(spark.range(1).select(sourcemap.unpacked_jump(x), sourcemap.unpacked_depth(x)).first()) == ("-", 77)
    v = lambda t: spark.range(1).select(sourcemap.vyper_source_map(F.lit(t))).first()[0]
    assert v('"1:2"') == "1:2"
    assert v('{"pc_pos_map_compressed":"3:4"}') == "3:4"
    assert sourcemap.decode(frame(spark, [("m", ""), ("n", None)], "id string, source_map string")).count() == 0


TREE = {
    "nodeType": "SourceUnit", "id": 1, "src": "0:99:0",
    "nodes": [
        {"nodeType": "ImportDirective", "id": 2, "src": "0:3:0", "file": "./x.sol"},
        {"nodeType": "ContractDefinition", "id": 3, "name": "L", "contractKind": "library", "src": "4:50:0", "nodes": [{"nodeType": "FunctionDefinition", "id": 4, "name": "f", "visibility": "internal", "src": "9:9:-1", "body": {"nodeType": "Block", "id": 5, "src": "1:1:0", "statements": [{"nodeType": "Identifier", "id": 6, "src": "20:1:0", "referencedDeclaration": 4}]}}]},
    ],
}


def test_trees(spark):
    n = ast.walk(frame(spark, [("a", json.dumps(TREE)), ("b", None), ("c", "{"), ("d", "[]")], "path string, ast string"))
    assert [r["id"] for r in n.orderBy("place").collect()] == [1, 2, 3, 4, 5, 6]
    assert rows(n.where("id = 6"), "depth", "parent_id", "contract_id", "referenced") == [(4, 5, 3, 4)]
    assert n.where("id = 4").first()["source"] is None
    assert rows(ast.contract_level_definitions(n), "id", "name", "contract_id") == [(4, "f", 3)]
    assert ast.references(n).first()["places"][0]["start"] == 20
    p = ast.parsed_from_ast(n).first()
    assert (p["imports"], p["contract_names"], [tuple(x) for x in p["libraries"]]) == (["./x.sol"], ["L"], [("L", True)])


def test_trees_have_pragmas_and_aliases(spark):
    pragma = lambda i, *words: {"nodeType": "PragmaDirective", "id": i, "src": f"{i}:1:0", "literals": list(words)}
    foreign = lambda i, name: {"nodeType": "Identifier", "id": i, "name": name, "src": f"{i}:1:0"}
    include = lambda i, **more: {"nodeType": "ImportDirective", "id": i, "src": f"{i}:1:0", **more}
    nodes = [
        pragma(2, "solidity", "^", "0.7", ".0"), pragma(3, "solidity", ">=", "0.8", ".0", "<", "0.9", ".0"), pragma(4, "experimental", "SMTChecker"), pragma(5, "abicoder", "v2"),
        include(6, file="./x.sol", unitAlias="X", symbolAliases=[]), include(7, file="./y.sol", unitAlias="", symbolAliases=[{"foreign": foreign(8, "A"), "local": "B"}, {"foreign": foreign(9, "C")}]), include(10, file="./z.sol"),
    ]
    trees = [("a", json.dumps({"nodeType": "SourceUnit", "id": 1, "src": "0:9:0", "nodes": nodes})), ("b", json.dumps(TREE))]
    got = {r["path"]: r for r in ast.parsed_from_ast(ast.walk(frame(spark, trees, "path string, ast string"))).collect()}
    assert (got["a"]["version_text"], got["a"]["experimental"], got["a"]["imports"]) == (">=0.8.0 <0.9.0", "SMTChecker", ["./x.sol", "./y.sol", "./z.sol"])
    assert [[tuple(x) for x in xs] for xs in got["a"]["aliases"]] == [[(None, "X")], [("A", "B"), (None, "C")], []]
    assert (got["b"]["version_text"], got["b"]["experimental"], got["b"]["aliases"]) == (None, None, [[]])


def test_edits_are_bytes(spark):
    s = frame(spark, [("a", "äbc"), ("b", "same")], "path string, content string")
    e = frame(spark, [("a", 2, 3, "X"), ("a", 0, 0, "// é\n"), ("a", 4, 4, "!")], "path string, start long, end long, text string")
    assert rows(edits.apply_edits(s, e), "path", "content") == [("a", "// é\näXc!"), ("b", "same")]


def test_flatten(spark):
    s = frame(
        spark,
        [
            ("lib/B.sol", "// SPDX-License-Identifier: GPL\npragma solidity >=0.7.0;\ncontract B {}\n"),
            ("src/A.sol", "// SPDX-License-Identifier: MIT\npragma solidity ^0.8.0;\npragma experimental X;\n\n\n\nimport {B as C} from 'lib/B.sol';\ncontract A is C {}\n"),
        ],
        "path string, content string",
    )
    edges = frame(spark, [("src/A.sol", "lib/B.sol")], "src string, dst string")
    text = edits.flatten(s, edges, frame(spark, [("src/A.sol",)], "path string")).first()["content"]
    assert text == "// SPDX-License-Identifier: MIT\npragma solidity >=0.7.0 ^0.8.0;\npragma experimental X;\n// lib/B.sol\n\ncontract B {}\n\n// src/A.sol\n\ncontract A is B {}\n"


def test_flatten_with_trees(spark):
    a, b = "import './B.sol';\ncontract X { function g(B x) public {} }\n", "contract X {}\ncontract B {}\n"
    s = frame(spark, [("A.sol", a), ("B.sol", b)], "path string, content string")
    trees = [
        ("A.sol", {"nodeType": "SourceUnit", "id": 1, "src": "0:90:0", "nodes": [{"nodeType": "ImportDirective", "id": 2, "src": "0:17:0"}, {"nodeType": "ContractDefinition", "id": 3, "name": "X", "src": "18:40:0", "nodes": [{"nodeType": "UserDefinedTypeName", "id": 4, "src": f"{a.index('B x')}:1:0", "referencedDeclaration": 12}]}]}),
        ("B.sol", {"nodeType": "SourceUnit", "id": 10, "src": "0:90:1", "nodes": [{"nodeType": "ContractDefinition", "id": 11, "name": "X", "src": "0:13:1"}, {"nodeType": "ContractDefinition", "id": 12, "name": "B", "src": "14:13:1"}]}),
    ]
    nodes = ast.walk(frame(spark, [(p, json.dumps(t)) for p, t in trees], "path string, ast string"))
    text = edits.flatten_with_trees(s, nodes, frame(spark, [("A.sol", "B.sol")], "src string, dst string"), "A.sol").first()["content"]
    assert "contract X_0 {}" in text
    assert "contract X_1 { function g(B x)" in text
    assert "import" not in text
    assert text.index("// B.sol") < text.index("// A.sol")


# Further lookups and merges


def test_infos_and_errors(spark):
    data = frame(spark, [("a.sol", "A", "1", "d"), ("b.sol", "A", "1", "d")], "path string, name string, version string, profile string")
    assert outputs.find_by_info(data, "b.sol:A").first()["path"] == "b.sol"
    assert outputs.find_by_info(data, "A").first()["path"] == "a.sol"
    assert outputs.take_by_info(data, "a.sol:A")[1].first()["path"] == "b.sol"
    ok = frame(spark, [(1, None)], "x int, error string")
    assert rows(outputs.all_or_error(ok), "x") == [(1,)]
    with pytest.raises(Exception, match="broke"):
        outputs.all_or_error(ok.unionByName(frame(spark, [(2, "broke")], "x int, error string"))).collect()
    assert outputs.artifacts_with_sources(data, data.withColumn("new", F.lit(1)).drop("new")).count() == 2


def test_merged_settings_restrictions(spark):
    from buildlens.functions.versions import merge_settings_restrictions

    schema = "a struct<evm_min:int,evm_max:int,via_ir:boolean,runs_min:int,runs_max:int,bytecode_hash:string>, b struct<evm_min:int,evm_max:int,via_ir:boolean,runs_min:int,runs_max:int,bytecode_hash:string>"
    none = (None,) * 6
    df = frame(spark, [((3, None, None, 1, None, "ipfs"), (1, 9, True, None, 5, None)), ((None, None, True, None, None, None), (None, None, False, None, None, None)), ((5, None, None, None, None, None), (None, 4, None, None, None, None)), (none, none)], schema)
    got = [r[0] for r in df.select(merge_settings_restrictions(F.col("a"), F.col("b"))).collect()]
    assert [None if g is None else tuple(g) for g in got] == [(3, 9, True, 1, 5, "ipfs"), None, None, none]


def test_interface_representation(spark):
    text = "contract C {\n  function a() internal {}\n  function b() public { }\n}\n"
    tree = {"nodeType": "SourceUnit", "id": 1, "nodes": [{"nodeType": "ContractDefinition", "id": 2, "contractKind": "contract", "nodes": [{"nodeType": "FunctionDefinition", "id": 3, "visibility": "internal", "src": "15:24:1"}, {"nodeType": "FunctionDefinition", "id": 4, "visibility": "public", "src": "42:23:1", "body": {"nodeType": "Block", "id": 5, "src": "62:3:1"}}]}]}
    s = frame(spark, [("a", text), ("b", text)], "path string, content string")
    nodes = ast.walk(frame(spark, [("a", json.dumps(tree))], "path string, ast string"))
    changed = s.withColumn("content", F.replace("content", F.lit("internal {}"), F.lit("internal {}")))
    before, after = (dict(rows(edits.interface_hashes(x, nodes), "path", "interface_hash")) for x in (s, changed))
    assert before == after
    assert before["a"] != before["b"]  # b has no tree: its whole content counts
    assert graph.format_imports("a", [("a", "^0.8"), ("b", None)], {"b"}) == "a ^0.8 imports:\n    ! b"

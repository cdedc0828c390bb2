"""Registered queries over their whole tables, against brute force on a small one."""

import random

import pytest

from buildlens.plans.queries import ORACLE_SQL, QUERIES

N = 160


def path(k):
    return f"src/d{k % 17}/C{k}" + (".t.sol" if k % 7 == 0 else ".yul" if k % 11 == 0 else ".sol")


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    """(folder, rows): a part table whose files all are targets and inputs."""
    rng = random.Random(5)
    rows = [(k, 1 + 5 * rng.randrange(10) if k < 18 else rng.randrange(1, 51), f"Brand#{rng.randrange(9)}") for k in range(1, N + 1)]
    folder = str(tmp_path_factory.mktemp("parts"))
    spark.createDataFrame(rows, "p_partkey long, p_size int, p_brand string").write.parquet(f"{folder}/part.parquet")
    return folder, rows


def closures():
    by = {}
    for k in range(3, N + 1):
        by.setdefault(path(k), set()).add(path(k // 3))
        if k % 50 == 0:
            by.setdefault(path(k // 3), set()).add(path(k))
    out = {}
    for k in range(N + 1):
        seen, todo = {path(k)}, [path(k)]
        while todo:
            fresh = by.get(todo.pop(), set()) - seen
            seen |= fresh
            todo += fresh
        out[path(k)] = seen
    return out


def in_order(reach, target):
    return sorted(reach[target], key=lambda n: (n == target, len(reach[n]), n.rsplit("/", 1)[1], n))


def test_ordered_dependencies_of_every_file(spark, parts):
    folder, rows = parts
    reach = closures()
    got = {(r["target"], r["place"]): r["path"] for r in QUERIES["ordered_dependencies"](spark, folder).collect()}
    assert got == {(path(k), i): n for k, *_ in rows for i, n in enumerate(in_order(reach, path(k)))}
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW part AS SELECT * FROM '{folder}/part.parquet/*.parquet'")
    sql = {(t, place): p for t, p, place in c.execute(f"SELECT target, path, place FROM ({ORACLE_SQL['ordered_dependencies']})").fetchall()}
    targets = {t for t, _ in sql}
    assert sql == {k: v for k, v in got.items() if k[0] in targets}


def test_flattened_sources_of_every_file(spark, parts):
    folder, rows = parts
    reach = closures()
    got = {r["target"]: r["content"] for r in QUERIES["flattened_sources"](spark, folder).collect()}
    assert sorted(got) == sorted(path(k) for k, *_ in rows)
    number = {path(k): k for k, *_ in rows}
    pragma = ["^0.8.0", ">=0.7.0 <0.9.0", "0.8.19", "~0.8.4", "^0.7.5"]
    for k, size, _ in rows:
        files = [rows[number[n] - 1] for n in in_order(reach, path(k)) if n in number]
        head = ["// SPDX-License-Identifier: MIT"] if size % 3 == 0 else []
        head.append(f"pragma solidity {' '.join(sorted({p for _, s, _ in files for p in pragma[s % 5].split()}))};")
        head += [f"pragma abicoder v{i % 3};" for i, s, _ in files if s % 4 == 0][:1]
        code = """contract {} is Token {{ string s = "T"; Token t = Token.make(xT, 'T'); /* T */ function T() }} // T or T"""
        bodies = [x for i, s, b in files for x in (f"// {path(i)}", code.format(b.replace("#", "_")), f"library L{i} {{ function f() {'public' if s % 2 == 0 else 'internal'} {{}} }}")]
        assert [x for x in got[path(k)].split("\n") if x] == head + bodies


def test_solved_versions_of_every_file(spark, parts):
    from buildlens.plans.queries import _INSTALLED

    folder, rows = parts
    fits = [lambda b, c: b == 8, lambda b, c: b in (7, 8), lambda b, c: (b, c) == (8, 19), lambda b, c: b == 8 and c >= 4, lambda b, c: b == 7 and c >= 5]
    reach, size = closures(), {path(k): s for k, s, _ in rows}
    able = {path(k): {v for v in _INSTALLED if all(fits[size[n] % 5](*v[1:]) for n in reach[path(k)] if n in size)} for k, *_ in rows}
    able = {p: a for p, a in able.items() if a}
    assert not set.intersection(*able.values()) and len({size[p] % 5 for p in able}) == 5
    taken, want = set(), {}
    for p in sorted(able):
        want[p] = max(able[p] & taken or able[p])
        taken.add(want[p])
    got = {r["path"]: r["version"] for r in QUERIES["solved_versions"](spark, folder).collect()}
    assert got == {p: ".".join(map(str, v)) for p, v in want.items()}


def test_versions_in_turn_by_file(spark):
    """A file may take what was chosen after the first file of its candidate set."""
    from buildlens.operators.solve import chosen_versions

    sets = [("a", [1]), ("b", [1, 2, 3]), ("c", [3]), ("d", [1, 2, 3])]
    rows = [(p, [([0, 8, x], True) for x in xs]) for p, xs in sets]
    c = spark.createDataFrame(rows, "path string, candidates array<struct<v: array<int>, installed: boolean>>")
    assert {r["path"]: r["v"][2] for r in chosen_versions(c).collect()} == {"a": 1, "b": 1, "c": 3, "d": 3}

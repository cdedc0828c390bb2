import json
import os
import random
from pathlib import Path

import pytest

from buildlens.plans import further_queries
from buildlens.plans.queries import ORACLE_SQL, QUERIES
from buildlens.sources import scan, sinks

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

ENTRIES = "path string, mtime_ms long, content_hash string, interface_hash string, source_name string, imports array<string>, version_text string, seen boolean"
KEYS = "path string, name string, version string, profile string, artifact_path string, build_id string"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture
def small_blocks(spark):
    """Files are split after so many bytes, if a test says so."""
    yield lambda n: spark.conf.set("spark.sql.files.maxPartitionBytes", str(n))
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def cache(seed):
    rng = random.Random(seed)
    name = lambda: "".join(rng.choice(["a", "}", "{", '"', "\\", "]", ",", "é", "\n", ":"]) for _ in range(rng.randrange(1, 9)))
    leaf = lambda: {"path": name(), "build_id": name()}
    entry = lambda: {"contentHash": name(), "imports": [name() for _ in range(rng.randrange(3))], "artifacts": {name(): {"0.8.1": {"default": leaf(), "fast": leaf()}} for _ in range(rng.randrange(3))}, "seenByCompiler": rng.random() < 0.5}
    members = [("_format", name()), ("paths", {"artifacts": name(), "more": {"files": {}}}), ("files", {f"{name()}{i}": entry() for i in range(30)}), ("builds", [name() for _ in range(5)]), ("profiles", {name(): {"solc": {"files": {"x": {}}}} for _ in range(4)}), ("last", {})]
    rng.shuffle(members)
    return dict(members)


@pytest.mark.parametrize(("seed", "block", "form"), [(1, 700, {}), (2, 2500, {"indent": 2}), (3, 1 << 20, {"separators": (",", ":"), "ensure_ascii": False})])
def test_a_cache_in_pieces_is_the_cache(spark, tmp_path, small_blocks, seed, block, form):
    path = str(tmp_path / "cache.json")
    (tmp_path / "cache.json").write_text(json.dumps(cache(seed), **form) + ("\n" if seed % 2 else ""))
    want = [rows(df) for df in scan.read_cache(spark, path, "root")]
    assert len(want[0]) == 30
    small_blocks(block)
    assert [rows(df) for df in scan.read_cache(spark, path, "root", whole=0)] == want


def test_odd_caches_in_pieces(spark, tmp_path, small_blocks):
    small_blocks(1500)
    whole = json.dumps(cache(7))
    for text in ["{}", '{"files":{},"builds":[]}', '{"files":{"n":null,"a":{"contentHash":"h"},"m":null},"builds":["b"]}', '{"files":{"a":{"contentHash":"h","artifacts":{}}}}', '{"builds":["b"],"files":null}', whole[: len(whole) // 2], whole.replace('"contentHash": ', '"contentHash" ', 1)]:
        (tmp_path / "cache.json").write_text(text)
        want = [rows(df) for df in scan.read_cache(spark, str(tmp_path / "cache.json"))]
        assert [rows(df) for df in scan.read_cache(spark, str(tmp_path / "cache.json"), whole=0)] == want, text


def test_cache_file_written_by_parts(spark, tmp_path, small_blocks):
    data = [(f'd{i % 7}/"{i}.sol', i, f"h{i}", None, "s\n}", [f"i{i}"] * (i % 3), None, i % 2 == 0) for i in range(200)]
    entries = spark.createDataFrame(data, ENTRIES).repartition(5)
    keys = [(p, f"N{j}", f"0.8.{j % 2}", "default", f"{p}/{j}.json", f"b{j}" if j else None) for p, i, *_ in data for j in range(i % 4)]
    artifacts = spark.createDataFrame(keys, KEYS).repartition(3)
    builds = artifacts.select("build_id")
    path = f"file://{tmp_path}/cache.json"
    for _ in range(2):  # an earlier file is replaced
        sinks.write_cache_file(entries, artifacts, builds, 'x"4', path)
    assert sorted(f.name for f in tmp_path.iterdir() if not f.name.startswith(".")) == ["cache.json"]
    assert json.loads((tmp_path / "cache.json").read_text()) == json.loads(sinks.cache_json(entries, artifacts, builds, 'x"4').first()["content"])
    assert max(map(len, (tmp_path / "cache.json").read_text().split("\n"))) < 600  # no row has it whole
    small_blocks(5000)
    held, found, listed = scan.read_cache(spark, path, whole=0)
    assert (rows(held.select(*entries.columns)), rows(found.select(*artifacts.columns)), rows(listed)) == (rows(entries), rows(artifacts), [("b1",), ("b2",)])
    sinks.write_cache_file(entries.limit(0), artifacts.limit(0), builds.limit(0), "x", path)
    assert json.loads((tmp_path / "cache.json").read_text()) == {"_format": "x", "files": {}, "builds": []}
    with pytest.raises(Exception, match="DUPLICATED_MAP_KEY"):
        sinks.write_cache_file(entries.union(entries), artifacts, builds, "x", path)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
@pytest.mark.parametrize("name", ["cache_file", "cache_as_one_file"])
def test_queries_hold_no_cache_in_one_row(spark, tmp_path, monkeypatch, small_blocks, name):
    """The file has a row for each entry, and the rows are right when it is read in pieces."""
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW orders AS SELECT * FROM '{DATA}/orders.parquet'")
    want = connection.execute(ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    monkeypatch.setattr(scan, "_bytes", lambda *_: 1 << 40, raising=False)
    monkeypatch.setattr(further_queries, "_folder", lambda *_: f"file://{tmp_path}/cache")
    small_blocks(20_000)
    assert rows(QUERIES[name](spark, DATA).select(*columns)) == sorted(want.fetchall(), key=str)
    (file,) = Path(tmp_path).rglob("cache.json")
    assert max(map(len, file.read_text().split("\n"))) < 5000

import json
import os
import random
import sys
import tracemalloc

import pytest
from pyspark.sql import functions as F

from buildlens.plans import further_queries, planner
from buildlens.plans.queries import ORACLE_SQL, QUERIES
from buildlens.sources import json_parts

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
JOBS = "path string, language string, version string, profile string"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def cut(text, rng, most):
    """The text in pieces of up to so many characters, some of them empty."""
    at = 0
    while at < len(text):
        n = rng.randrange(most + 1)
        yield text[at : at + n]
        at += n


def whole(parts):
    """What the members of all parts hold, as one object."""
    out = {}
    for p in map(json.loads, parts):
        ((name, v),) = p.items()
        if isinstance(v, dict):
            assert not v.keys() & out.get(name, {}).keys()
            out.setdefault(name, {}).update(v)
        elif isinstance(v, list):
            out.setdefault(name, []).extend(v)
        else:
            out[name] = v
    return out


@pytest.mark.parametrize("form", [{}, {"indent": 2}, {"separators": (",", ":"), "ensure_ascii": False}])
def test_parts_of_a_text_in_pieces_have_all_of_it(form):
    rng = random.Random(5)
    name = lambda: "".join(rng.choice(["a", "}", "{", '"', "\\", "]", ",", "é", "\n", ":", "😀"]) for _ in range(rng.randrange(1, 9)))
    value = lambda: rng.choice([name(), -12.5e-3, 123456789, True, None, {}, [], {name(): [name(), {"x": 1.25}]}])
    for most in (1, 2, 7, 1000):
        text = {"errors": [value() for _ in range(50)], "n": -1.5e10, "contracts": {f"{name()}{i}": value() for i in range(50)}, 's"': name(), "t": None, "last": {"k": 1}}
        for size in (1, 60, 1 << 13):
            got = list(json_parts.parts(cut(json.dumps(text, **form) + " \n", rng, most), size))
            assert whole(got) == text
            assert len(got) == 6 if size > 5000 else len(got) > 10
    assert list(json_parts.parts(["{", '"a":{},"b":[ ],"c":0', "} "])) == ['{"c":0}']
    assert list(json_parts.parts(["{ }"])) == []


@pytest.mark.parametrize("text", ["", "[]", "{", '{"a":{"b":1}', '{"a":{"b":1}}}', '{"a":{"b":1 "c":2}}', '{"a":{b:1}}', '{"a":[1,]}', '{"a" 1}', '{"a":[1}', '{"a":1.}', '{"a":"x'])
def test_what_is_no_object_is_an_error(text):
    with pytest.raises(ValueError, match="JSON|Expecting|Unterminated"):
        list(json_parts.parts(cut(text, random.Random(1), 3)))


def test_the_cut_holds_little():
    def pieces():
        yield '{"sources":{'
        for i in range(100_000):
            yield f'{"," if i else ""}"{i}":{{"content":"{"x" * 200}"}}'
        yield "}}"

    tracemalloc.start()
    n = sum(p.count("content") for p in json_parts.parts(pieces()))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 100_000
    assert peak < 2 << 20  # of 22 MB


def streams():
    """A compiler by streams: a warning for each file, the version in each contract; whatever it was given, in `given`."""

    def compile_stream(version, pieces):
        text = "".join(pieces)
        sources = json.loads(text)["sources"]
        yield json.dumps({"errors": [{"severity": "warning", "errorCode": "1878", "sourceLocation": {"file": p}} for p in sources]})[:-1]
        yield ', "given": ' + json.dumps(text)
        yield ', "contracts": ' + json.dumps({p: {"C": {"abi": [], "evm": {"bytecode": {"object": version}}}} for p in sources}) + ', "sources": ' + json.dumps({p: {"id": i} for i, p in enumerate(sources)}) + "}"

    return compile_stream


def test_streams_of_jobs_are_the_jobs(spark):
    data = [(f'd{i % 3}/"é{i}\n.sol', "Solidity" if i % 5 else "Vyper", f"0.8.{i % 2}", "default", None if i == 7 else f'c"{i}\n\\é😀') for i in range(60)]
    made = spark.createDataFrame(data, JOBS + ", content string").repartition(3)
    jobs, sources = made.drop("content"), made.select("path", "content")
    inputs = {r["job_id"]: r["input"] for r in planner.job_inputs(jobs, sources, '{"o":1}').collect()}
    assert len(inputs) == 4
    for parallel in (None, 1, 3):
        done = planner.run_job_streams(jobs, sources, {"Solidity": streams(), "Vyper": streams()}, '{"o":1}', parallel).cache()
        assert {r["job_id"]: json.loads(r["output"])["given"] for r in done.where("output like '{\"given\"%'").collect()} == inputs
        diagnostics, contracts, found = planner.output_tables(done)
        assert rows(diagnostics.select("version", "file", "error_code")) == sorted(((d[2], d[0], 1878) for d in data), key=str)
        assert rows(contracts.select("path", "version", "name", "bytecode")) == sorted(((d[0], d[2], "C", d[2]) for d in data), key=str)
        assert found.count() == len(data)
        done.unpersist()
    tasks = planner.run_job_streams(jobs, sources, {"Solidity": streams(), "Vyper": streams()}, parallel=2).select(F.spark_partition_id().alias("task"), "job_id").distinct()
    assert sorted(r["count"] for r in tasks.groupBy("task").count().collect()) == [2, 2]
    with pytest.raises(Exception, match="no compiler for Vyper"):
        planner.run_job_streams(jobs, sources, {"Solidity": streams()}).collect()
    with pytest.raises(Exception, match="twice"):
        planner.run_job_streams(jobs, sources.union(sources), {"Solidity": streams(), "Vyper": streams()}).collect()


def test_programs_by_streams():
    echo = [sys.executable, "-c"]
    run = lambda code: "".join(planner.process_stream(echo[0], [echo[1], code])("0.8.0", iter(['{"é"', ":1\r\n}"])))
    assert run("import sys; sys.stdout.buffer.write(sys.stdin.buffer.read())") == '{"é":1\r\n}'
    with pytest.raises(RuntimeError, match="ended with 3: broke"):
        run("import sys; print('broke', file=sys.stderr, end=''); sys.exit(3)")


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
def test_compiled_contracts_hold_no_job_in_one_row(spark, monkeypatch):
    """No row of input or output has more than a part of a job, and the rows are right when parts are small."""
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW part AS SELECT * FROM '{DATA}/part.parquet'")
    want = connection.execute(ORACLE_SQL["compiled_contracts"])
    columns = [d[0] for d in want.description]
    widths = []

    def noted(outputs, tables=planner.output_tables):
        widths.append(outputs.agg(F.max(F.length("output"))).first()[0])
        return tables(outputs)

    monkeypatch.setattr(planner, "output_tables", noted)
    monkeypatch.setattr(planner, "job_inputs", lambda *_: pytest.fail("all files of a job in one row"))
    assert rows(QUERIES["compiled_contracts"](spark, DATA).select(*columns)) == sorted(want.fetchall(), key=str)
    assert max(widths) < 10_000
    assert json.loads(further_queries._stub("0.7.6", '{"sources":{"a":{"content":"xy"}}}'))["contracts"] == {"a": {"C2": {"abi": [], "evm": {"bytecode": {"object": "606"}}}}}

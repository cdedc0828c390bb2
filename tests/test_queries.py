"""Every registered project query against its DuckDB SQL, on the smallest of the driver's tables."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

from buildlens.plans.queries import ORACLE_SQL, QUERIES

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
REPO = Path(__file__).resolve().parent.parent
duckdb = pytest.importorskip("duckdb")
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")


def plain(rows, columns):
    show = lambda v: "null" if v is None or v != v else repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted(tuple(show(r[c]) for c in columns) for r in rows)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("part", "events", "orders", "lineitem", "pages"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@needs_data
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    want = duck.execute(ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(df.columns)
    rows = [dict(zip(columns, r, strict=True)) for r in want.fetchall()]
    assert plain([r.asDict() for r in df.collect()], columns) == plain(rows, columns)


@needs_data
@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_without_sql(spark, name):
    rows = QUERIES[name](spark, DATA).collect()
    assert rows
    if name == "conflict_free_files":
        assert len({r["file"].lower() for r in rows}) == len(rows)
    if name == "flattened_sources":
        assert all("import" not in r["content"] and r["content"].count("pragma") == 1 for r in rows)
    if name == "solved_versions":
        assert {r["version"] for r in rows} == {"0.8.19"} or all(r["version"] for r in rows)


def test_everything_imports_without_the_llm_folder(tmp_path):
    """The entry module and the rest work where the llm folder and the pipeline are gone."""
    for f in [*(REPO / "buildlens").rglob("*.py"), REPO / "__spark_entry__.py"]:
        if "llm" not in f.relative_to(REPO).parts:
            to = tmp_path / f.relative_to(REPO)
            to.parent.mkdir(parents=True, exist_ok=True)
            to.write_text(f.read_text())
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') and n[2].isdigit() for n in q); assert set(e.oracle_sql()) <= set(q); print(len(q))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": str(tmp_path)}, check=False)
    assert done.returncode == 0, done.stderr

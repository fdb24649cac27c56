"""Every registered query of the engine against its SQL on the smallest tables, and the import without the optional folders."""

import os
import subprocess
import sys

import pytest

from lexiloom import catalog
from lexiloom.session import TABLES

SF = os.environ.get("LEXILOOM_TEST_SF", "/root/testdata/sf0.001")
duckdb = pytest.importorskip("duckdb")


def cell(v):
    if v is None or v != v:
        return "~"
    if isinstance(v, float):
        return f"{v:.6g}"
    return str(int(v)) if isinstance(v, bool) else str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple(cell(r[i]) for i in order) for r in data)


@pytest.fixture(scope="module")
def db():
    if not os.path.isdir(SF):
        pytest.skip("no test tables here")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_its_sql(spark, db, name):
    got = catalog.QUERIES[name](spark, SF)
    want = db.execute(catalog.ORACLES[name])
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(names, want.fetchall())


def test_queries_without_sql_are_held_against_python():
    """Each has a test of its own in test_answers.py or test_whole.py; a new one without SQL has to be added there."""
    assert set(catalog.QUERIES) - set(catalog.ORACLES) == {
        "gate_report", "language_scores", "html_blocks", "rule_mining", "split_long", "style_lint", "lint_verdicts", "cleaned_answers", "provider_run",
    }


def test_entry_imports_without_the_optional_folders(tmp_path):
    """A copy of the library without lexiloom/llm and corpus_pipeline.py still registers its queries."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    os.symlink(f"{root}/__spark_entry__.py", tmp_path / "__spark_entry__.py")
    (tmp_path / "lexiloom").mkdir()
    for n in os.listdir(f"{root}/lexiloom"):
        if n != "llm":
            os.symlink(f"{root}/lexiloom/{n}", tmp_path / "lexiloom" / n)
    code = "import sys; sys.path.insert(0, '.'); import __spark_entry__ as e; q = e.queries(); assert len(q) > 50 and not any(k.startswith('op') or k == 'pipeline' for k in q); assert set(e.oracle_sql()) <= set(q)"
    env = {**os.environ, "PYTHONPATH": str(tmp_path), "PYTHONDONTWRITEBYTECODE": "1", "PYTHONSAFEPATH": "1"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True)

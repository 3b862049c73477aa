"""Every query of the catalogue against its SQL on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from talkatlas.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.6g}"
    return str(value)


@pytest.mark.parametrize("name", list(catalog.ORACLE_SQL))
def test_query(spark, tables, name):
    want = tables.sql(catalog.ORACLE_SQL[name])
    names = [c[0] for c in want.description]
    frame = catalog.QUERIES[name](spark, SF)
    assert sorted(frame.columns) == sorted(names)
    got = frame.select(*names).collect()
    assert sorted(tuple(map(plain, r)) for r in got) == sorted(tuple(map(plain, r)) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_without_sql(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_entry_imports_without_optional_parts(tmp_path):
    """A copy of the repository without the llm folders and the pipeline still works."""
    import shutil
    import subprocess
    import sys

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "talkatlas", tmp_path / "talkatlas", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(q.startswith('op') for q in e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "HOME": str(tmp_path)}, check=True)
    assert out.stdout.split()[-1] == "False" and int(out.stdout.split()[-3]) == len(catalog.QUERIES)

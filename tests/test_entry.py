import os
import re
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent


def test_queries_have_oracles():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.oracle_sql()) > 80


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 8


@pytest.mark.parametrize("left", [(), ("corpus_pipeline.py",)])
def test_imports_without_the_optional_part(tmp_path, left):
    """The rest stands without the training-data subpackage, whether or not its pipeline's file is left, and whatever PYTHONPATH is."""
    shutil.copytree(ROOT / "sievework", tmp_path / "sievework", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", *left):
        if (ROOT / name).exists():
            shutil.copy(ROOT / name, tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'missing_columns' in q and not any(k.startswith('op1_') or k == 'pipeline' for k in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120, env=os.environ | {"PYTHONPATH": str(tmp_path)})


def test_nothing_else_imports_it():
    for p in (ROOT / "sievework").rglob("*.py"):
        if "llm" not in p.parts:
            assert not re.search(r"import.*\bllm\b|from.*\bllm\b", p.read_text(encoding="utf-8")), p


@pytest.mark.parametrize("name", ["missing_columns", "dup_rows_first", "stats_quantiles", "neardup_groups", "coerce_int", "rule_outliers", "contract_checks"])
def test_query_against_duckdb(spark, name):
    import duckdb

    import __spark_entry__ as e

    sf = "/root/testdata/sf0.001"
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    cur = c.execute(e.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    want = sorted(repr(tuple(v for _, v in sorted(zip(names, row)))) for row in cur.fetchall())
    df = e.queries()[name](spark, sf)
    assert sorted(df.columns) == sorted(names)
    assert sorted(repr(tuple(r[c] for c in sorted(names))) for r in df.collect()) == want

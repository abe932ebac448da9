"""Every registered query runs; those with SQL give the same rows as DuckDB."""

import pytest

from sightline import queries

from compare import same


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, data, name):
    same(spark, data, queries.QUERIES[name], queries.ORACLES[name])


def test_every_query_has_sql():
    assert set(queries.QUERIES) == set(queries.ORACLES)


def test_corpus_operators_can_be_taken_away(tmp_path):
    """Without their folders, and with or without the pipeline, everything else imports."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    for name in ("sightline", "__spark_entry__.py", "corpus_pipeline.py"):
        if (root / name).is_dir():
            shutil.copytree(root / name, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        elif (root / name).exists():
            shutil.copy(root / name, tmp_path / name)
    code = "import __spark_entry__ as e; assert len(e.queries()) > 100 and not any(n.startswith('op') or n == 'pipeline' for n in e.queries()); assert set(e.oracle_sql()) <= set(e.queries())"
    for _ in range(2):
        subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"} | {k: v for k, v in __import__("os").environ.items() if k.startswith(("JAVA", "SPARK"))}, check=True, timeout=120)
        (tmp_path / "corpus_pipeline.py").unlink(missing_ok=True)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_plans(spark, data):
    """The recent sightings plan prunes columns, pushes the filter down and takes the limit without a full sort."""
    plan = queries.recent_sightings(spark, data)._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in plan and "PushedFilters: [IsNotNull" in plan

"""Every registered query of the reference operators against its SQL."""

import math

import pytest
from conftest import DATA

from tessera.plans.registry import ORACLES, QUERIES


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return round(v, 9) + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    cur = duck.execute(ORACLES[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    want = sorted(repr([plain(r[names.index(c)]) for c in order]) for r in cur.fetchall())
    assert sorted(repr([plain(r[c]) for c in order]) for r in df.collect()) == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    df = QUERIES[name](spark, DATA)
    rows = df.collect()
    assert rows and not any(isinstance(v, float) and math.isnan(v) for r in rows for v in r)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 16
    assert set(e.oracle_sql()) <= set(e.queries())


def test_without_the_text_operators(tmp_path):
    """With their folders, or with the pipeline's file as well, taken out, the rest imports."""
    import os
    import shutil
    import subprocess
    import sys

    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for keep in (True, False):
        to = tmp_path / str(keep)
        shutil.copytree(f"{here}/tessera", to / "tessera", ignore=shutil.ignore_patterns("llm", "__pycache__"))
        shutil.copy(f"{here}/__spark_entry__.py", to)
        if keep and os.path.exists(f"{here}/corpus_pipeline.py"):
            shutil.copy(f"{here}/corpus_pipeline.py", to)
        code = "import __spark_entry__ as e; q = e.queries(); assert 'fasta_files' in q and not any(n.startswith('op') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"
        subprocess.run([sys.executable, "-c", code], cwd=to, check=True, env={**os.environ, "PYTHONPATH": ""})

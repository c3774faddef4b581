import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry
from prismview import catalog

REPO = Path(entry.__file__).parent
SMALL = "/root/testdata/sf0.001"


def test_every_twin_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(catalog.QUERIES) == len(catalog.queries())


def test_entry_imports_without_the_training_data_operators(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(REPO, copy, ignore=shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__", ".pytest_cache"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'cold_filter' in q and not any(n.startswith('op') for n in q) and 'pipeline' not in q; assert e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, timeout=120)


@pytest.mark.skipif(not Path(SMALL).exists(), reason="needs the test tables")
def test_engine_queries_match_their_twins(spark):
    import duckdb

    con = duckdb.connect()
    for f in Path(SMALL).glob("*.parquet"):
        con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    for name in ("conflict_demotion", "hash_sample_strata", "noise_flip", "relation_extensional", "hypergeom_bounds", "predecessor_fractions", "slack_admit"):
        ours = catalog.queries()[name](spark, SMALL)
        columns = sorted(ours.columns)
        got = sorted(str(tuple(r)) for r in ours.select(*columns).collect())
        want = sorted(str(r) for r in con.sql(f"SELECT {', '.join(columns)} FROM ({catalog.oracle_sql()[name]})").fetchall())
        assert got == want, name

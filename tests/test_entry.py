import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

DATA = Path("/root/testdata/sf0.001")
ROOT = Path(__file__).resolve().parents[1]
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SAMPLE = ("normalize_nodes", "exid_repair_status", "native_relation_collapse", "cypher_l1_opened_by", "cypher_comp_agg", "cypher_pack_optional_slice")


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", SAMPLE)
def test_queries_equal_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got, want = entry.queries()[name](spark, str(DATA)), con.sql(entry.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    order = [want.columns.index(c) for c in sorted(want.columns)]
    plain = lambda v: "" if v is None else f"{v:.6f}" if isinstance(v, float) else str(v)
    a = sorted([plain(r[c]) for c in sorted(got.columns)] for r in got.collect())
    assert a == sorted([plain(r[i]) for i in order] for r in want.fetchall()) and a


def test_the_rest_stands_without_the_corpus_operators(tmp_path):
    import shutil

    shutil.copytree(ROOT / "loomgraph", tmp_path / "loomgraph", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'cypher_comp_agg' in q and 'pipeline' not in q and not any(n.startswith('op') for n in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path), "HOME": "/tmp"})

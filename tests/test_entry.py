import glob
import os
import shutil
import subprocess
import sys

import pytest

import __spark_entry__ as entry

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
duckdb = pytest.importorskip("duckdb")
#: One query of each family; all of them run side by side with their SQL in the driver.
NAMES = ["bm25_and", "bm25_postings", "search_union_four_sources", "phrase_match", "like_floor", "excerpts", "terrain_terms", "knn_quantized", "chunk_documents", "dedup_mapping", "custody_union", "health_ghost_sessions", "interval_join_nearest_30s", "tree_reparent", "upsert_actions", "joins_three_way", "win_first_last_nth", "recursive_cte", "fn_math", "fn_choice", "date_modifiers", "json_read", "match_ranked", "windows_session", "p5_found", "p5_descendants"]


def test_entry_and_contract(spark):
    assert entry.entry(spark).count() >= 0
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 150


def _sorted(rows, columns):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple(repr(round(r[i], 6) if isinstance(r[i], float) else r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", NAMES)
def test_query_gives_what_its_sql_gives(spark, sf, name):
    frame = entry.queries()[name](spark, sf)
    db = duckdb.connect()
    for file in glob.glob(f"{sf}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(file)[:-8]} AS SELECT * FROM '{file}'")
    found = db.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(frame.columns)
    assert _sorted([tuple(r) for r in frame.collect()], frame.columns) == _sorted(found.fetchall(), columns)


def test_the_rest_stands_without_the_llm_folder(tmp_path):
    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", ".pytest_cache"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'p5_found' in q and 'p1_found' not in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", check=True)
    subprocess.run([sys.executable, "-m", "pytest", "-x", "-q", "tests/test_sql.py", "tests/test_drift.py"], cwd=tmp_path / "repo", check=True, timeout=600)

"""The driver contract: every query runs on the smallest tables, SQL names match."""

import os
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CHECKED = ["normalized_records", "derived_fields", "document_normalization", "keys_recovery", "pairs_tight", "estimates_inference", "aggregated_evidence", "scored_S2", "wide_score", "match_results", "recall_at_k", "best_threshold", "block_recovery_S2", "pool_audit", "error_triage", "split_ids", "result_faults", "fault_report", "transliterated_names", "margin_pairs", "joint_thresholds", "threshold_grid", "pointwise_rows", "linear_utilities", "holdout_evaluation", "labelled_evidence", "shard_sizes"]


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", CHECKED)
def test_against_sql(spark, sf_dir, name):
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    wanted = con.sql(entry.oracle_sql()[name])
    columns = sorted(wanted.columns)
    df = entry.queries()[name](spark, sf_dir)
    assert sorted(df.columns) == columns

    def plain(v):
        return round(v, 6) + 0.0 if isinstance(v, float) else v

    got = sorted(([plain(r[c]) for c in columns] for r in df.collect()), key=repr)
    names = wanted.columns
    expected = sorted(([plain(dict(zip(names, r))[c]) for c in columns] for r in wanted.fetchall()), key=repr)
    assert got == expected


@pytest.mark.parametrize("left", [[], ["corpus_pipeline.py"]])
def test_the_rest_works_without_the_optional_parts(tmp_path, left):
    """In a copy without their folders, whether the pipeline's file is left or not."""
    root = entry.__file__.rsplit("/", 1)[0]
    shutil.copytree(root, tmp_path / "copy", ignore=shutil.ignore_patterns(".git", "__pycache__", "spark-warehouse", "*.json", "*.txt"))
    for gone in ("spindrift/llm", "tests/llm"):
        shutil.rmtree(tmp_path / "copy" / gone)
    if not left:
        (tmp_path / "copy" / "corpus_pipeline.py").unlink()
    code = "import __spark_entry__ as e; assert 'match_results' in e.queries() and not any(n.startswith('op') or n in ('pipeline', 'language_of_pages') for n in e.queries()); assert 'match_results' in e.oracle_sql(); import bench"
    env = {**os.environ, "PYTHONPATH": str(tmp_path / "copy")}
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path / "copy", env=env)
    subprocess.run([sys.executable, "-m", "pytest", "--collect-only", "-q", "tests"], check=True, cwd=tmp_path / "copy", env=env, capture_output=True)


def test_other_import_errors_are_not_hidden(tmp_path):
    code = "import sys; sys.modules['numpy'] = None; import __spark_entry__"
    done = subprocess.run([sys.executable, "-c", code], cwd=entry.__file__.rsplit("/", 1)[0], capture_output=True, text=True)
    assert done.returncode and "numpy" in done.stderr

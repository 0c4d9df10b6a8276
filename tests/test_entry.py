"""The registered queries, against a second SQL engine, and without the parts that may be taken away."""

import glob
import math
import os
import shutil
import subprocess
import sys

import __spark_entry__ as entry
import duckdb
import pytest

FOLDER = "/root/testdata/sf0.001"
CHECKED = ["degree", "reg_norm_laplacian_entries", "attr_freq_rank", "attr_report", "harness_runs", "npmi_brand", "sim_npmi2d", "matvec_pmi", "joint_block_matvec", "impute_median", "kde_log_ratio", "mc_precision_curve", "elbow_profile", "elbow_choice", "nominate_bayes", "vocabulary_index", "pca_total_variance", "logreg_gradient", "edges_from_text", "attributes_from_csv", "objects_saved_and_loaded", "precision_saved"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    return round(float(x), 4) + 0.0 if isinstance(x, float) else (x.item() if hasattr(x, "item") else x)


@pytest.mark.parametrize("name", CHECKED)
def test_against_the_oracle(spark, duck, name):
    got, want = entry.queries()[name](spark, FOLDER).toPandas(), duck.execute(entry.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda df: sorted(map(repr, (tuple(map(plain, r)) for r in df[columns].itertuples(index=False, name=None))))
    assert rows(got) == rows(want)


def test_entry_and_registry(spark):
    assert entry.entry(spark).count() == 50
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_filters_reach_the_scan(spark):
    from graphnom.plans.fixtures import Fixtures

    f = Fixtures(spark, FOLDER)
    plan = f.edges()._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint>" in plan


def test_without_the_subpackage(tmp_path):
    """Both llm folders gone, the pipeline's module still there: the rest imports, and its tests are found and pass."""
    root = os.path.dirname(os.path.abspath(entry.__file__))
    copy = tmp_path / "copy"
    shutil.copytree(root, copy, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__"))
    assert (copy / "corpus_pipeline.py").exists() and not (copy / "graphnom" / "llm").exists() and not (copy / "tests" / "llm").exists()
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and not any(k.startswith('op') for k in q) and len(q) > 40; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, timeout=120)
    subprocess.run([sys.executable, "-m", "pytest", "tests", "--collect-only", "-q"], cwd=copy, check=True, timeout=120)
    subprocess.run([sys.executable, "-m", "pytest", "tests/test_graph.py", "-x", "-q"], cwd=copy, check=True, timeout=600)


def test_errors_within_the_subpackage_are_not_hidden(tmp_path):
    root = os.path.dirname(os.path.abspath(entry.__file__))
    copy = tmp_path / "copy"
    shutil.copytree(root, copy, ignore=shutil.ignore_patterns(".git", "tests", "__pycache__"))
    shutil.rmtree(copy / "graphnom" / "llm", ignore_errors=True)
    (copy / "graphnom" / "llm").mkdir()
    (copy / "graphnom" / "llm" / "__init__.py").write_text("import no_such_module\n")
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=copy, capture_output=True, timeout=120)
    assert done.returncode and b"no_such_module" in done.stderr

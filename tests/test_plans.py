"""Shape of the plans: no products, group limits before shuffles, no Python where expressions do."""

import io
import os
import shutil
import subprocess
import sys
from contextlib import redirect_stdout

import pytest

from corpuslens.plans import registry

SF = "/root/testdata/sf0.001"

def plan(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


NATIVE = [
    "review_findings", "rank_issues", "similar_issues", "related_files", "resolve_imports", "find_usages", "parse_diff",
    "chunk_documents", "incremental_index", "tool_budget", "memory_retention", "reassemble_stream", "parse_sse", "page_links",
    "change_complexity", "related_tests", "symbols_js", "batches", "dedupe_issues",
]


@pytest.mark.parametrize("name", NATIVE)
def test_native_plans(spark, name):
    text = plan(registry.QUERIES[name](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "Python" not in text and "InPandas" not in text


@pytest.mark.parametrize("name", ["dedupe_issues", "memory_retention", "find_usages", "vector_search", "rank_imports", "similar_issues"])
def test_group_limit_before_shuffle(spark, name):
    assert "WindowGroupLimit" in plan(registry.QUERIES[name](spark, SF))


@pytest.mark.parametrize("name", ["parse_diff", "chunk_documents", "symbols_js", "changed_code", "parse_sse", "page_links"])
def test_row_wise_work_has_one_exchange_at_most(spark, name):
    """Only the spread of a small input; cutting and parsing never shuffle."""
    text = plan(registry.QUERIES[name](spark, SF))
    tree = text.split("\n\n\n")[0]
    assert "hashpartitioning" not in text and tree.count("Exchange") <= 2  # a subquery may count rows


def test_severity_filter_is_pushed_and_columns_pruned(spark):
    text = plan(registry.QUERIES["scan_files"](spark, SF))
    assert "PushedFilters: [IsNotNull(n_chars), LessThanOrEqual(n_chars,102400)" in text


def test_registry_names_match():
    assert set(registry.ORACLE) <= set(registry.QUERIES)
    assert len(registry.QUERIES) > 125


def test_the_entry_imports_without_the_training_operators(tmp_path):
    """With the subpackage and its tests deleted, with and without the pipeline module."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    copy = tmp_path / "repo"
    shutil.copytree(root, copy, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", ".pytest_cache"))
    run = [sys.executable, "-B", "-c", "import __spark_entry__ as e; print(len(e.queries()))"]
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    for _ in range(2):
        done = subprocess.run(run, cwd=copy, env=env, capture_output=True, text=True)
        assert done.returncode == 0, done.stderr
        assert int(done.stdout.split()[-1]) == len(registry.QUERIES)
        (copy / "corpus_pipeline.py").unlink(missing_ok=True)

"""Queries over tables whose targets lie in another repository: the number of documents is no multiple of four, so that targets wrap."""

import os

import pytest

from quarrywork.plans import queries as core

from .oracle import TABLES, same

SMALL = "/root/testdata/sf0.001"
#: The number of documents at which a statement of each query's language wraps to a file of its own.
CASES = [
    (198, "complexity_score"), (198, "suggestions"),
    (198, "resolve_relative_imports"),
    (198, "valid_edges"), (198, "budget_edges_in_focus"),
    (198, "match_path_alias"), (198, "dispatch_resolution"), (198, "resolve_python_imports"), (182, "resolve_rust_imports"), (186, "resolve_java_imports"),
]


@pytest.mark.parametrize(("documents", "name"), CASES)
def test_targets_in_another_repository(spark, tmp_path, documents, name):
    for t in TABLES:
        if t != "documents":
            os.symlink(f"{SMALL}/{t}.parquet", tmp_path / f"{t}.parquet")
    spark.read.parquet(f"{SMALL}/documents.parquet").filter(f"doc_id < {documents}").toPandas().to_parquet(tmp_path / "documents.parquet")
    assert same(spark, core.QUERIES[name], core.ORACLES[name], str(tmp_path))

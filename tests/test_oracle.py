"""Spark result = DuckDB oracle on sf0.001 for a fast sample of keys; the entry smoke check."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry
from conftest import SMOKE_DIR
from oracle_harness import compare, duck

FAST = ["ngram_counts", "jm_probability", "rank_names", "tokenize", "vocab_build", "usages", "mask_literals",
        "path_contexts", "child_id", "k_hop_subgraph", "last_write", "beam_score", "latest_state",
        "captured_params", "loo_counts", "scope_root", "stream_latest_state", "candidates"]
ALL = os.environ.get("NAMEMINE_ALL_KEYS") == "1"


@pytest.fixture(scope="module")
def con():
    return duck(SMOKE_DIR)


@pytest.mark.parametrize("key", sorted(entry.queries()) if ALL else FAST)
def test_matches_oracle(spark, con, key):
    r = compare(spark, con, key, SMOKE_DIR)
    assert r["status"] in ("match", "rows-only"), r


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and df.columns == ["decl_id", "name", "p", "rank"]

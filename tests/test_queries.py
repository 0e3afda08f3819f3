"""A cross-section of registered queries against DuckDB at the smallest scale; tools/check.py runs all of them."""

import glob
import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))
import check  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from conftest import SF  # noqa: E402

NAMES = [
    "feature_stats", "masked_quantiles", "mixture_stats", "action_chunk", "relative_chunk", "normalise_q99", "nearest_asof_join",
    "keep_range_join", "merge_packs", "nested_subsets", "pack_shards_sequential", "dct_quantise", "chunk_error_report",
    "scan_eval_log", "stream_episode_sessions", "bimanual_relative_actions",
]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(SF + "/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    assert check.compare(entry.queries()[name](spark, SF), con.execute(entry.oracle_sql()[name])) is None


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() == 640


def test_every_oracle_has_a_query():
    from gaitworks.plans import catalog

    assert set(catalog.ORACLES) == set(catalog.QUERIES)
    assert set(entry.oracle_sql()) <= set(entry.queries())

"""Queries of exact quantiles where every pass meets the rows in another order, as on a cluster."""

import glob
import os
import sys
from functools import partial

import duckdb
import numpy as np
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))
import check  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from conftest import SF  # noqa: E402
from gaitworks.operators import stats  # noqa: E402
from gaitworks.plans import scoring_queries, tables  # noqa: E402

NAMES = [
    "denormalise_q99",
    "feature_stats",
    "latency_percentiles",
    "normalise_q99",
    "normalise_state_tolerant",
    "normalised_label_means",
    "quantile_bins",
    "quantile_bins_decode",
    "quantile_eps",
]


@pytest.fixture
def dealt_anew(spark, many_parts, monkeypatch):
    """Rows of a table go to another partition each time they are read; sketches are short enough to lose ranks."""
    read = tables.table

    def table(spark, d, name):
        def deal(parts):
            rng = np.random.default_rng()  # a new seed each time
            for pdf in parts:
                yield pdf.assign(part=rng.integers(0, 1000, len(pdf)))

        df = read(spark, d, name)
        fields = ", ".join(f"{c} {t}" for c, t in df.dtypes)
        return df.mapInPandas(deal, f"{fields}, part long").repartition(8, "part").drop("part")

    for module in (tables, scoring_queries):
        monkeypatch.setattr(module, "table", table)
    monkeypatch.setattr(stats, "full_stats", partial(stats.full_stats, accuracy=40))
    spark.conf.set("spark.sql.exchange.reuse", "false")
    yield
    spark.conf.unset("spark.sql.exchange.reuse")


@pytest.mark.parametrize("name", NAMES)
def test_quantiles_equal_sql_in_any_order(spark, dealt_anew, name):
    con = duckdb.connect()
    for f in glob.glob(SF + "/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    assert check.compare(entry.queries()[name](spark, SF), con.execute(entry.oracle_sql()[name])) is None


@pytest.fixture(scope="module")
def gaps(tmp_path_factory):
    """Events of a null type, a type without a value, and a dimension that nobody filled."""
    d, con = str(tmp_path_factory.mktemp("gaps")), duckdb.connect()
    con.execute(f"""copy (select * replace (case when event_id % 7 = 0 then null else event_type end as event_type, case when event_type = 'error' then null else value end as value)
      from '{SF}/events.parquet') to '{d}/events.parquet'""")
    con.execute(f"copy (select * replace (list_transform(embedding, lambda x, i: case when i <> 4 then x end) as embedding) from '{SF}/embeddings.parquet') to '{d}/embeddings.parquet'")
    return d


@pytest.mark.parametrize("name", NAMES)
def test_null_keys_and_unfilled_dimensions_keep_their_place(spark, gaps, name):
    con = duckdb.connect()
    for f in glob.glob(gaps + "/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    sql = entry.oracle_sql()[name]
    if name == "feature_stats":  # the moments count values, the SQL counts rows
        sql = sql.replace("count(*)", "count(value)")
    assert check.compare(entry.queries()[name](spark, gaps), con.execute(sql)) is None

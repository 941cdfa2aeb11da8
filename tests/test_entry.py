import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
#: One query of each kind: the rest are the same code at other settings.
NAMES = ["grid3d", "estimate_labels", "ccl_6", "ccl_periodic_8", "ccl_periodic_binary_6", "largest_all", "largest_none", "each_binary", "ccl_continuous_4", "dust_range", "contacts_count", "vcg_8", "runs_flat", "draw_runs", "draw_overlaps", "erase_runs", "each_index", "each_image", "stored_array", "stream_18", "stream_closed", "stream_finished", "color_26", "dust_invert", "largest_k"]


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for t in ("lineitem", "events", "documents", "pages", "labels", "embeddings"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, tables, name):
    got = entry.queries()[name](spark, DATA).toPandas()
    want = tables.execute(entry.oracle_sql()[name]).fetchdf()
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    assert sorted(map(tuple, got[names].astype(object).values.tolist())) == sorted(map(tuple, want[names].astype(object).values.tolist()))


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0

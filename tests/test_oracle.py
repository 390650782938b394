"""Every registered query against its SQL, on the smallest test data."""

import pytest

import __spark_entry__ as contract
from bindings.sessions import NAMED
from gaugeworks.operators.sessions import LIST_COLUMNS
from tests.check import compare, oracle_rows

SF_DIR = "/root/testdata/sf0.001"
UNORDERED_SAMPLE = {"a16_raw_events"}  # any 100 documents: only their number is defined


def test_every_query_has_sql():
    own = {name for name in contract.queries() if name != "pipeline" and not name.startswith("op")}
    assert own - set(contract.oracle_sql()) == UNORDERED_SAMPLE


@pytest.mark.parametrize("name", sorted(n for n in contract.oracle_sql() if not n.startswith("op")))
def test_matches_sql(spark, name):
    assert compare(spark, name, SF_DIR) is None


@pytest.mark.parametrize("name", ["a08_session_summary", "a08_session_summary_fleet"])
def test_session_summaries_hold_the_children_of_every_session(spark, name):
    """Both sides have the three lists, for sessions beyond those that ``a08_session_lists`` names too."""
    df = contract.queries()[name](spark, SF_DIR)
    assert set(LIST_COLUMNS) <= set(df.columns)
    columns, data = oracle_rows(SF_DIR, contract.oracle_sql()[name])
    beyond = df.where(f"session_id > {max(NAMED)}").collect()
    for c in LIST_COLUMNS:
        expected = sum(r[columns.index(c)] is not None for r in data if r[columns.index("session_id")] > max(NAMED))
        assert sum(r[c] is not None for r in beyond) == expected > 0


def test_raw_events_sample(spark):
    rows = contract.queries()["a16_raw_events"](spark, SF_DIR).collect()
    assert len(rows) == 100 and all(r.event_data.startswith("<event ") for r in rows)


def test_entry(spark):
    result = contract.entry(spark)
    assert result.columns[:6] == [
        "query_id",
        "plan_id",
        "execution_type",
        "count_executions",
        "bucket_start",
        "bucket_end",
    ]
    assert result.count() > 0

"""Reports over large tables are made in steps: the same rows, and shuffle files of one step at a time."""

import os
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from gaugeworks.plans import materialize as M
from gaugeworks.plans import relational as R
from tests.check import rows
from tests.test_relational import plan

SF_DIR = "/root/testdata/sf0.001"
REPORTS = (
    "a08_session_summary",
    "a08_session_summary_fleet",
    "a08_child_places",
    "a09_session_tasks",
    "a09_session_tasks_fleet",
    "a10_blocking_fleet",
)


def shuffles(df):
    return len(re.findall(r"Exchange (?:hash|range)partitioning", plan(df)))


@pytest.mark.parametrize("name", REPORTS)
def test_the_last_step_only_sorts(spark, monkeypatch, tmp_path, name):
    """What is left to run has the sort's shuffle alone, and of the tables of all steps only the last one is kept."""
    monkeypatch.setattr(M, "shared_dir", lambda spark: str(tmp_path))
    whole = contract.queries()[name](spark, SF_DIR)
    expected = rows(whole.columns, whole.collect())
    before = set(os.listdir(tmp_path))
    monkeypatch.setattr(M, "STEP_BYTES", 0)
    stepped = contract.queries()[name](spark, SF_DIR)
    assert shuffles(stepped) == 1
    assert len(set(os.listdir(tmp_path)) - before) == 1
    assert rows(stepped.columns, stepped.collect()) == expected


def test_what_a_step_does_not_own_stays(spark, monkeypatch, tmp_path):
    """Only stored tables are deleted, and none that the later table still reads."""
    monkeypatch.setattr(M, "shared_dir", lambda spark: str(tmp_path / "shared"))
    spark.range(5).write.parquet(str(tmp_path / "source"))
    source = spark.read.parquet(str(tmp_path / "source"))
    table = M.stored(source, "rows")
    M.unstore(source, spark.range(1))
    M.unstore(table, table.where("id > 1"))
    assert source.count() == table.count() == 5
    M.unstore(table, source)
    assert not os.listdir(tmp_path / "shared")


def test_sort_columns_of_a_list_move_once(spark):
    df = spark.createDataFrame([(1, 3, "a"), (1, None, "c"), (1, 3, "b"), (2, 1, "z"), (1, 3, "a")], "k int, v int, w string")
    named = R.nest(df, ["k"], ["w", "v"], ["v", "w"], "vs")
    by_value = R.nest(df, ["k"], ["w", "v"], [F.col("v"), F.col("w")], "vs")
    assert sorted(named.collect()) == sorted(by_value.collect())
    assert "collect_list(struct(v" in plan(named)

"""Relational helpers against brute force, with hot keys, and the shape of their plans."""

import random

import pytest
from pyspark.sql import functions as F

from gaugeworks.functions.summaries import merge_summary
from gaugeworks.plans import relational as R


def plan(df):
    """The physical plan before adaptive execution changed it."""
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]


def as_set(df):
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_left_join_many_with_a_hot_key(spark):
    left = spark.createDataFrame([(i, f"l{i}") for i in range(20)], "k int, a string")
    right = spark.createDataFrame([(3 if i % 3 else i % 25, i) for i in range(600)], "k int, b int")
    expected = as_set(left.join(right, "k", "left"))
    assert as_set(R.left_join_many(left, right, ["k"])) == expected
    assert as_set(R.left_join_many(left, right, ["k"], left.union(left))) == expected


def test_disjunctive_join(spark):
    left = spark.createDataFrame([(i, i + 1000, i % 7) for i in range(50)], "a int, b int, x int")
    right = spark.createDataFrame([((i % 60) + (1000 if i % 4 == 2 else 0), i % 4, i) for i in range(400)], "k int, t int, y int")
    branches = [("a", "k", F.col("t").isin(1, 3)), ("b", "k", F.col("t") == 2)]
    joined = R.disjunctive_join(left, right, branches)
    expected = {
        (la, lb, x, k, t, y)
        for la, lb, x in map(tuple, left.collect())
        for k, t, y in map(tuple, right.collect())
        if (la == k and t in (1, 3)) or (lb == k and t == 2)
    }
    assert as_set(joined.select("a", "b", "x", "k", "t", "y")) == expected
    assert "CartesianProduct" not in plan(joined) and "NestedLoop" not in plan(joined)


def test_top_k(spark):
    df = spark.createDataFrame([("a" if i % 3 else "b", i % 11, i) for i in range(100)], "g string, m int, id int")
    order = [F.desc("m"), F.asc("id")]
    ranked = sorted(map(tuple, df.collect()), key=lambda r: (-r[1], r[2]))
    assert [tuple(r) for r in R.top_k(df, order, 7).collect()] == ranked[:7]
    expected = {r for g in "ab" for r in [x for x in ranked if x[0] == g][:7]}
    assert as_set(R.top_k(df, order, 7, ["g"])) == expected
    assert "TakeOrderedAndProject" in plan(R.top_k(df, order, 7))
    assert "WindowGroupLimit" in plan(R.top_k(df, order, 7, ["g"]))


def test_first_per(spark):
    df = spark.createDataFrame([(i % 4 if i % 2 else 0, i % 5, i) for i in range(80)], "g int, m int, id int")
    first = R.first_per(df, ["g"], [F.desc("m"), F.asc("id")])
    best = {}
    for g, m, i in sorted(map(tuple, df.collect()), key=lambda r: (-r[1], r[2])):
        best.setdefault(g, (g, m, i))
    assert as_set(first) == set(best.values())
    assert plan(first).count("WindowGroupLimit") == 2  # before and after the shuffle


def test_nest(spark):
    rows = [("hot" if i % 3 == 0 else f"k{i % 40}", i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, v int")
    lists = {r.k: [e.v for e in r.vs] for r in R.nest(df, ["k"], ["v"], [-F.col("v")], "vs").collect()}
    assert sorted((k, v) for k, vs in lists.items() for v in vs) == sorted(rows)
    assert all(vs == sorted(vs, reverse=True) for vs in lists.values())


def test_disjunctive_join_keeps_the_type_of_its_keys(spark):
    left = spark.createDataFrame([(1.5, "a", 1)], "x double, s string, i int")
    right = spark.createDataFrame([(1.2, "a", 1, 0), (1.5, "b", 2, 0)], "y double, t string, j bigint, kind int")
    join = lambda a, b: R.disjunctive_join(left, right, [(a, b, F.col("kind") == 0)])
    assert [r.y for r in join("x", "y").collect()] == [1.5]
    assert [r.t for r in join("s", "t").collect()] == ["a"]
    assert [r.j for r in join("i", "j").collect()] == [1]
    with pytest.raises(ValueError):
        join("s", "j")


def test_lookups(spark):
    df = spark.createDataFrame([(1, 7), (2, None), (3, 9)], "id int, k int")
    dim = spark.createDataFrame([(7, "b"), (7, "a"), (8, "c")], "k int, n string")
    assert as_set(R.lookup_one(df, dim, ["k"], "n").select("id", "n")) == {(1, "a"), (2, None), (3, None)}
    second = spark.createDataFrame([(3, "z")], "id int, n string")
    found = R.first_match(df, [(dim, ["k"], "n"), (second, ["id"], "n")], "found", F.lit("none"))
    assert as_set(found.select("id", "found")) == {(1, "a"), (2, "none"), (3, "z")}
    blocked = spark.createDataFrame([(1,), (1,), (None,)], "parent int")
    flagged = R.flag_parents(df, blocked, "id", "parent", "is_parent")
    assert as_set(flagged.select("id", "is_parent")) == {(1, True), (2, False), (3, False)}


def test_scalar_and_totals(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "i string, v int")
    limit = spark.createDataFrame([("a", 10), ("b", 20)], "i string, lim int")
    assert as_set(R.with_scalar(df, limit, "lim", ["i"])) == {("a", 1, 10), ("b", 2, 20)}
    single = R.with_scalar(df, limit.filter("i = 'a'"), "lim")
    assert as_set(single) == {("a", 1, 10), ("b", 2, 10)}
    totals = R.merge_totals([df.groupBy().agg(F.sum("v").alias("v")), limit.groupBy().agg(F.sum("lim").alias("lim"))])
    assert as_set(totals) == {(3, 30)}
    assert "Cartesian" not in plan(totals) and "NestedLoop" not in plan(single)


def test_broadcast_is_checked(spark):
    small, big = spark.range(10), spark.range(50)
    assert "Broadcast" in plan(big.join(R.broadcast_if_small(small, 20), "id"))
    hint = R.broadcast_if_small(big, 20)
    assert "ResolvedHint" not in hint._jdf.queryExecution().analyzed().toString()


def test_conditional_counts(spark):
    df = spark.createDataFrame([(1, True), (1, True), (2, False)], "db int, modified boolean")
    counted = R.conditional_counts(df, ["db"], {"clean": ~F.col("modified"), "dirty": F.col("modified")})
    assert as_set(counted) == {(1, None, 2), (2, 1, None)}
    summed = df.groupBy().agg(R.sum_if(F.col("modified"), "db").alias("s"))
    assert summed.first()["s"] == 2


SUMMARY = "avg_duration double, min_duration bigint, max_duration bigint, stdev_duration double, count_executions bigint"


def test_merge_summary_by_hand(spark):
    df = spark.createDataFrame([(10.0, 1, 20, 3.0, 2), (40.0, 40, 40, 0.0, 1)], SUMMARY)
    row = df.agg(*merge_summary("duration", 1)).first().asDict()
    assert row == {
        "total_duration": 60.0,
        "avg_duration": 20.0,
        "min_duration": 1.0,
        "max_duration": 40.0,
        "stdev_duration": 2.45,
        "variation_duration": 0.12,
    }
    idle = df.withColumn("count_executions", F.lit(0).cast("bigint")).agg(*merge_summary("duration", 1)).first()
    assert idle["avg_duration"] is None and idle["variation_duration"] == 0.0


def test_merged_summaries_equal_the_raw_rows(spark):
    """Total, average, least and greatest of merged records are those of the runs behind them."""
    rng = random.Random(5)
    runs = [(rng.randrange(6), rng.randrange(20), rng.randrange(1, 5000)) for _ in range(2000)]
    raw = spark.createDataFrame(runs, "plan int, slot int, us int")
    records = raw.groupBy("plan", "slot").agg(
        F.avg("us").alias("avg_duration"),
        F.min("us").alias("min_duration"),
        F.max("us").alias("max_duration"),
        F.stddev_pop("us").alias("stdev_duration"),
        F.count("*").alias("count_executions"),
    )
    merged = {r.plan: r for r in records.groupBy("plan").agg(*merge_summary("duration")).collect()}
    for p in range(6):
        us = [u for plan_, _, u in runs if plan_ == p]
        row = merged[p]
        assert abs(row.total_duration - sum(us) / 1000) < 0.011
        assert abs(row.avg_duration - sum(us) / len(us) / 1000) < 0.006
        assert abs(row.min_duration - min(us) / 1000) < 0.006
        assert abs(row.max_duration - max(us) / 1000) < 0.006

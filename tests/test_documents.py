"""Stored documents: long and broken ones, what a report reads of them, date folders, and places without one task."""

import re
import time
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from bindings.tables import Bound
from gaugeworks.functions.xml import node_count, nodes
from gaugeworks.operators import events
from gaugeworks.plans import relational as R
from gaugeworks.sources import tables as table_files
from gaugeworks.sources.event_files import read_raw_events, save_raw_events
from tests.test_plans import settings
from tests.test_relational import plan

SF_DIR = "/root/testdata/sf0.001"
MEGABYTE = 1 << 20


def cut(spark, *documents, tag="deadlock"):
    rows = spark.createDataFrame([(i, d) for i, d in enumerate(documents)], "i int, document string")
    found = rows.select("i", nodes("document", tag).alias("n"), node_count("document", tag).alias("c")).orderBy("i").collect()
    assert all((len(r.n) if r.n is not None else 0) == r.c for r in found)
    return [r.n for r in found]


def in_value(body, before=""):
    return f'<event name="e"><data name="r">{before}<value>{body}</value></data></event>'


def test_elements_with_and_without_bodies(spark):
    bodies = ["<deadlock/>", '<deadlock a="x>y/">t<b/></deadlock>', "<deadlock\n a='1'\t/>", "<deadlock >\n</deadlock>"]
    others = ["<deadlock-list/>", "<deadlocks>x</deadlocks>", "<deadlock", "<deadlock>", '<deadlock a="/>']
    text = lambda part: part
    assert cut(spark, *map(in_value, bodies)) == [[text(b)] for b in bodies]
    assert cut(spark, *map(in_value, others)) == [[]] * len(others)
    assert cut(spark, in_value("".join(bodies)), None, "", "<deadlock/>", "<data><text><deadlock/></text></data>") == [bodies, None, [], [], []]
    assert cut(spark, in_value("<deadlock/>", before="<type name='a>b'/>") + in_value("<deadlock x=''/>")) == [["<deadlock/>", "<deadlock x=''/>"]]
    assert cut(spark, "<data><text/></data><value><deadlock/></value>") == [[]]


@pytest.mark.parametrize(
    ("body", "n"),
    [
        ("<deadlock " + "".join(f'a{i}="v{i}>" ' for i in range(80_000)) + "/>", 1),
        ("<deadlock a='" + "x" * MEGABYTE + "'>b</deadlock>", 1),
        ("<deadlock>" + "<p a='1'>t</p>" * 80_000 + "</deadlock>", 1),
        ("<deadlock>" + "y" * MEGABYTE + "</deadlock>", 1),
        ("<deadlock " + 'a="' * 300_000, 0),
        ('<deadlock a="' + "z" * MEGABYTE, 0),
        ("<deadlock>" + "t<" * 400_000, 0),
        ("<deadlock/>" * 90_000, 90_000),
        ('<deadlock "' * 90_000, 0),
    ],
)
def test_a_megabyte_of_each_form(spark, body, n):
    begin = time.time()
    [found] = cut(spark, in_value(body))
    assert len(found) == n and time.time() - begin < 10
    [found] = cut(spark, f'<event><data name="r"><value>{body}')  # a truncated document
    assert found == []


def documents(spark, n):
    body = '<data name="r"><value>{}</value></data>'
    rows = [
        ("xml_deadlock_report", f'<event name="xml_deadlock_report" timestamp="2024-01-{1 + i % 9:02}T10:00:{i % 60:02}Z">{body.format(g)}</event>')
        for i in range(n)
        for g in ["" if i % 3 else f'<deadlock id="{i}"/>' * (1 + i % 2)]
    ]
    return spark.createDataFrame(rows, "object_name string, event_data string")


@pytest.mark.parametrize("keys", [(), ("server",)])
def test_graph_counts_are_kept_at_ingest(spark, tmp_path, keys):
    raw = documents(spark, 120)
    save_raw_events(raw, str(tmp_path / "raw"))
    held = read_raw_events(spark, str(tmp_path / "raw"))
    assert held.columns == ["object_name", "event_data", "event_time", "graph_count"]
    with_keys = lambda df: df.withColumn("server", F.upper("object_name")) if keys else df
    options = {"n": 7, "utc_offset": -90, "keys": keys}
    found = events.deadlock_graphs(with_keys(held), **options)
    assert found.collect() == events.deadlock_graphs(with_keys(raw), **options).collect()
    with settings(spark, spark__sql__maxMetadataStringLength="2000"):
        text = plan(found)
    ranking = text[text.rindex("TakeOrderedAndProject" if not keys else "WindowGroupLimit") :]
    assert "event_time" in ranking and "graph_count" in ranking and "event_data" not in ranking
    assert re.search(r"graph_count#\d+ > 0", ranking) and "regexp" not in ranking


def test_days_choose_folders(spark, tmp_path):
    save_raw_events(documents(spark, 60), str(tmp_path / "raw"))
    some = read_raw_events(spark, str(tmp_path / "raw"), days=("2024-01-03", datetime(2024, 1, 4)))
    assert {r.event_time.day for r in some.collect()} == {3, 4}
    assert re.search(r"PartitionFilters: \[[^\]]*event_date", plan(some))


def test_snapshots_are_read_by_capture_date(spark, tmp_path):
    rows = spark.createDataFrame(
        [("i", datetime(2024, 1, d, 23 * (d % 2)), d, f"db{d}") for d in range(1, 8)], "instance_id string, captured_at timestamp, database_id int, name string"
    )
    table_files.save(rows.filter("database_id < 4"), str(tmp_path), "databases", by_date=True)
    table_files.save(rows.filter("database_id >= 4"), str(tmp_path), "databases", by_date=True, mode="append")
    some = table_files.load(spark, str(tmp_path), "databases", fleet=True, dates=("2024-01-02", "2024-01-05"))
    assert sorted(r.database_id for r in some.collect()) == [2, 3, 4, 5]
    assert re.search(r"PartitionFilters: \[[^\]]*capture_date", plan(some))
    everything = table_files.load(spark, str(tmp_path), "databases", fleet=True)
    assert everything.count() == 7 and set(everything.columns) == {"instance_id", "captured_at", "database_id", "name"}
    table_files.save(rows, f"{tmp_path}/plain", "databases")
    with pytest.raises(ValueError):
        table_files.load(spark, f"{tmp_path}/plain", "databases", fleet=True, dates=("2024-01-02", "2024-01-05"))


def test_places_are_counted_where_the_rows_are(spark):
    ids = spark.range(5000, numPartitions=7).withColumn("k", F.pmod(F.xxhash64("id"), F.lit(500)))
    with settings(spark, spark__sql__adaptive__coalescePartitions__enabled="false"):
        placed = R.numbered(ids.orderBy("k", "id"))
        rows = [(r.k, r.id) for r in sorted(placed.collect(), key=lambda r: r.place)]
    assert rows == sorted(rows) and sorted(r.place for r in placed.collect()) == list(range(1, 5001))
    assert R.numbered(ids.limit(0).orderBy("id")).count() == 0
    # the only window is over one count per partition
    text = plan(placed)
    assert text.count("SinglePartition") == 1 and "Window [sum(_rows" in text and "row_number" not in text


def test_all_documents_have_no_limit(spark):
    raw = documents(spark, 150)
    assert events.raw_events(raw, n=None).count() == 150 and events.raw_events(raw).count() == 100
    assert "Limit" not in plan(events.raw_events(raw, n=None))

"""Streams: late rows, restarts, rotated files."""

import time
from datetime import datetime
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from gaugeworks.constants import DEPRECATION_EVENTS
from gaugeworks.functions.summaries import merge_summary
from gaugeworks.functions.xml import EVENT
from gaugeworks.plans.materialize import CHECKPOINT_DIR, new_folder, shared_dir
from gaugeworks.sources.event_files import read_events
from gaugeworks.streaming.aggregates import (
    event_count_totals,
    event_counts_stream,
    read_totals,
    workload_buckets_stream,
    workload_totals,
    write_totals,
)
from gaugeworks.streaming.capture import (
    LateRows,
    capture_events,
    event_stream,
    read_cracked,
    read_event_files,
    read_latest,
    rolled,
    write_changes,
    write_cracked,
    write_event_files,
    write_stream,
)
from gaugeworks.streaming.segments import Segments

ONE = (
    '<event name="{name}" timestamp="2024-01-01T10:{minute:02}:00Z">'
    '<data name="feature"><value>F{minute}</value></data>'
    '<action name="session_id"><value>{minute}</value></action>'
    '<action name="sql_text"><value>select 1\nfrom t where a &lt; 2</value></action></event>'
)


def write_file(folder, name, *events):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("<events>" + "".join(ONE.format(name=n, minute=m) for n, m in events) + "</events>")


def test_rotated_files_are_read_by_pattern(spark, tmp_path):
    kind = DEPRECATION_EVENTS[0]
    write_file(tmp_path / "x", "cap_0_1.xml", (kind, 1), (kind, 2))
    write_file(tmp_path / "x", "cap_0_2.xml", (kind, 3))
    write_file(tmp_path / "x", "other_0_1.xml", (kind, 4))
    events = read_events(spark, f"{tmp_path}/x/cap_0_2.xml", "cap.xml")
    assert sorted(r._timestamp[14:16] for r in events.collect()) == ["01", "02", "03"]


@pytest.mark.parametrize("place", [None, "progress"])
def test_capture_keeps_the_wanted_events_and_resumes(spark, tmp_path, place):
    """Also where no place for the progress is named."""
    source, out = tmp_path / "in", str(tmp_path / "out")
    progress = {"checkpoint": str(tmp_path / place)} if place else {}
    write_file(source, "a.xml", (DEPRECATION_EVENTS[0], 1), ("other", 2))

    def capture():
        query = capture_events(spark, str(source), out, trigger=None, max_records_per_file=1, **progress)
        query.awaitTermination()
        return spark.read.parquet(out)

    first = capture().collect()
    assert [(r.event_type, r.feature, r.session_id) for r in first] == [(DEPRECATION_EVENTS[0], "F1", 1)]
    assert first[0].event_time == datetime(2024, 1, 1, 10, 1)
    assert first[0].sql_text == "select 1\nfrom t where a < 2" and first[0].username is None
    write_file(source, "b.xml", (DEPRECATION_EVENTS[1], 5), (DEPRECATION_EVENTS[0], 6))
    assert sorted(r.session_id for r in capture().collect()) == [1, 5, 6]
    assert capture().count() == 3  # nothing new: nothing twice


def test_event_stream_has_the_event_schema(spark, tmp_path):
    (tmp_path / "in").mkdir()
    stream = event_stream(spark, str(tmp_path / "in"), max_files=1)
    assert stream.isStreaming and stream.schema == spark.createDataFrame([], EVENT).schema


def drain(spark, df, tmp_path):
    write_stream(df, str(tmp_path / "out"), trigger=None, checkpoint=str(tmp_path / "progress")).awaitTermination()
    return spark.read.schema(df.schema).parquet(str(tmp_path / "out"))


def test_counts_drop_late_rows_and_hold_open_hours(spark, tmp_path):
    def arrive(*times):
        rows = [(datetime.fromisoformat(f"2024-01-01T{t}"), "click") for t in times]
        spark.createDataFrame(rows, "ts timestamp, event_type string").coalesce(1).write.mode("append").parquet(
            str(tmp_path / "in")
        )

    def run():
        stream = spark.readStream.schema("ts timestamp, event_type string").parquet(str(tmp_path / "in"))
        counts = drain(spark, event_counts_stream(stream, "10 minutes"), tmp_path)
        return {(r.bucket_start.hour, r.occurances) for r in counts.collect()}

    arrive("09:10", "09:50", "10:05")
    assert run() == set()  # 9:00 stays open until 10:10 was seen
    arrive("09:59", "10:20")
    assert run() == {(9, 3)}
    arrive("09:30", "12:00")  # 9:30 comes after its hour was closed
    assert run() == {(9, 3), (10, 2)}


def test_changes_hold_open_hours_and_late_rows_are_counted(spark, tmp_path):
    schema, out, by = "ts timestamp, event_type string", str(tmp_path / "out"), ("bucket_start", "bucket_end", "event_type")
    late = LateRows(spark)

    def run(*times):
        rows = [(datetime.fromisoformat(f"2024-01-01T{t}"), "click") for t in times]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        counts = event_counts_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "10 minutes")
        query = write_changes(counts, out, by, trigger=None, fan=2)
        query.awaitTermination()
        latest = read_latest(spark, out, counts.schema, by, fan=2)
        return {(r.bucket_start.hour, r.occurances) for r in latest.collect()}, query

    def counted(query, n):
        """A listener hears of a batch a moment after it ended."""
        deadline = time.time() + 20
        while late.count(query) != n and time.time() < deadline:
            time.sleep(0.1)
        return late.count(query) == n

    try:
        assert run("09:10", "09:50", "10:05")[0] == {(9, 2), (10, 1)}
        hours, query = run("09:59", "10:20")
        assert hours == {(9, 3), (10, 2)} and counted(query, 0)
        hours, query = run("09:30", "12:00")
        assert hours == {(9, 3), (10, 2), (12, 1)} and counted(query, 1)
    finally:
        late.stop()


def test_totals_take_rows_of_any_lateness(spark, tmp_path):
    schema, out, totals = "ts timestamp, event_type string", str(tmp_path / "out"), event_count_totals()

    def run(*times):
        rows = [(t and datetime.fromisoformat(t), "click") for t in times]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        write_totals(stream, totals, out, trigger=None, fan=2).awaitTermination()
        found = read_totals(spark, totals, out, stream.schema, fan=2).collect()
        assert all((r.bucket_end - r.bucket_start).total_seconds() == 3600 for r in found)
        return {(r.bucket_start.day, r.bucket_start.hour): r.occurances for r in found}

    assert read_totals(spark, totals, out, spark.createDataFrame([], schema).schema).count() == 0
    assert run("2024-01-05T09:10", "2024-01-05T10:05", None) == {(5, 9): 1, (5, 10): 1}
    assert run("2024-01-01T09:10", "2024-01-05T09:59") == {(1, 9): 1, (5, 9): 2, (5, 10): 1}
    assert run("2024-01-01T09:20") == {(1, 9): 2, (5, 9): 2, (5, 10): 1}
    assert run() == {(1, 9): 2, (5, 9): 2, (5, 10): 1}


def test_folded_segments_keep_the_rows_in_few_folders(spark, tmp_path):
    held = Segments(spark, str(tmp_path / "held"), fan=4)
    batch = lambda n: spark.createDataFrame([(n % 3, 1)], "k int, n long").coalesce(1)
    add = lambda rows: rows.groupBy("k").agg({"n": "sum"}).withColumnRenamed("sum(n)", "n").coalesce(1)
    before = None
    for number in range(70):
        if number == 37:  # a reader that began before the next folds
            before = held.read(batch(0).schema)
            before.count()
        held.put(batch(number), number, add)
        if number in (0, 3, 4, 15, 16, 17, 40, 64, 69):
            found = {r.k: r.n for r in add(held.read(batch(0).schema)).collect()}
            assert found == {k: len(range(k, number + 1, 3)) for k in range(3) if k <= number}
            assert len(held.names()) <= 3 * 4
        if number == 38:
            assert add(before).agg({"n": "sum"}).first()[0] == 37
    assert len(list((tmp_path / "held").iterdir())) <= 3 * 2 * 4  # what was replaced goes one fold later
    held.put(batch(69), 69, add)  # the last batch once more, after a failure
    held.put(batch(64), 64, add)
    assert sum(r.n for r in held.read(batch(0).schema).collect()) == 70
    with pytest.raises(ValueError):
        Segments(spark, "x", fan=1)


def test_a_batch_that_was_not_finished_is_not_read(spark, tmp_path):
    held = Segments(spark, str(tmp_path / "held"))
    rows = spark.createDataFrame([(1,)], "k int")
    held.put(rows, 0, lambda r: r)
    held.put(rows, 1, lambda r: r)
    (tmp_path / "held" / f"segment-{1:012d}-{1:012d}" / "_SUCCESS").unlink()
    assert held.read(rows.schema).count() == 1
    held.put(rows, 1, lambda r: r)
    assert held.read(rows.schema).count() == 2


def test_event_files_roll_by_bytes(spark, tmp_path):
    source, out, limit = tmp_path / "in", str(tmp_path / "out"), 4096
    long = ONE.replace("F{minute}", "é&amp;" * 150 + "F{minute}")
    huge = ONE.replace("F{minute}", "x" * 9000)
    source.mkdir()
    for name, events in (("a.xml", [long.format(name="e", minute=m) for m in range(10, 60)] + [ONE.format(name="e", minute=m) for m in range(10, 60)]), ("b.xml", [huge.format(name="h", minute=11)])):
        (source / name).write_text("<events>" + "".join(events) + "</events>")

    def capture():
        write_event_files(event_stream(spark, str(source), max_files=1), out, max_bytes=limit, trigger=None).awaitTermination()
        return read_event_files(spark, out).selectExpr("*", "_metadata.file_size as size").collect()

    found = capture()
    assert len(found) == 101 and {r.size > limit for r in found if r._name == "e"} == {False}
    assert [r.size > limit for r in found if r._name == "h"] == [True]
    features = [next(d.value for d in r.data if d._name == "feature") for r in found if r._name == "e"]
    assert sorted(features) == sorted([f"F{m}" for m in range(10, 60)] + ["é&" * 150 + f"F{m}" for m in range(10, 60)])
    assert len(capture()) == 101  # nothing twice


def test_files_of_rows_stay_within_the_limit(spark):
    sizes = spark.range(3000, numPartitions=3).selectExpr("1 + pmod(xxhash64(id), if(id % 50 = 0, 900, 60)) as size")
    files = rolled(sizes, F.col("size"), 1000).groupBy("file").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()
    assert max(r.bytes for r in files) <= 1000 and sum(r.n for r in files) == 3000
    assert sum(r.bytes > 800 for r in files) > 50


def test_names_follow_the_databases(spark, tmp_path):
    out, schema = str(tmp_path / "out"), "object_name string, event_data string"
    known = spark.createDataFrame([(1, "one")], "database_id int, name string")
    more = spark.createDataFrame([(1, "one"), (2, "two")], "database_id int, name string")

    def run(names, minute):
        document = f'<event name="e" timestamp="2024-01-01T10:{minute}:00Z"><action name="database_id"><value>2</value></action></event>'
        spark.createDataFrame([("e", document)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        write_cracked(stream, lambda: names, out, trigger=None).awaitTermination()
        found = read_cracked(spark, out, spark.createDataFrame([], schema), names)
        return [(r.event_time.minute, r.database_name) for r in found.orderBy("event_time").collect()]

    assert run(known, 10) == [(10, None)]
    assert run(more, 20) == [(10, None), (20, "two")]


def test_totals_of_summaries_equal_the_batch(spark, tmp_path):
    ddl = (
        "last_execution_time timestamp, plan_id bigint, execution_type_desc string, count_executions bigint, "
        "avg_duration double, min_duration bigint, max_duration bigint, stdev_duration double"
    )
    rows = [(datetime(2024, 1, 1 + i % 3, i % 24, i % 60), i % 4, "Regular", i % 5, float(i % 7), i, i + 3, 2.0) for i in range(300)]
    totals = workload_totals(("duration",))
    for k in range(3):
        spark.createDataFrame(rows[k::3], ddl).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    write_totals(stream, totals, str(tmp_path / "out"), trigger=None, fan=2).awaitTermination()
    streamed = read_totals(spark, totals, str(tmp_path / "out"), stream.schema, fan=2)
    table = spark.createDataFrame(rows, ddl)
    batch = table.groupBy(F.window("last_execution_time", "1 hour").start.alias("bucket_start"), "plan_id", F.col("execution_type_desc").alias("execution_type")).agg(
        F.sum("count_executions").alias("count_executions"), *merge_summary("duration")
    )
    assert set(batch.columns) == set(streamed.columns) - {"bucket_end"}
    assert sorted(streamed.select(*batch.columns).collect()) == sorted(batch.collect())


def test_streamed_summaries_equal_the_batch(spark, tmp_path):
    rows = [
        (datetime(2024, 1, 1, 9 + i // 40, i % 60), i % 4, "Regular", 1 + i % 5, float(i), i, i + 3, 2.0)
        for i in range(120)
    ]
    ddl = (
        "last_execution_time timestamp, plan_id bigint, execution_type_desc string, count_executions bigint, "
        "avg_duration double, min_duration bigint, max_duration bigint, stdev_duration double"
    )
    spark.createDataFrame(rows, ddl).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(ddl).parquet(str(tmp_path / "in"))
    streamed = drain(spark, workload_buckets_stream(stream, ("duration",), "0 seconds"), tmp_path)
    by_hour = {}
    for at, plan_, _, n, avg, *_ in rows:
        by_hour.setdefault((at.hour, plan_), []).append((n, avg))
    last = max(at.hour for at, *_ in rows)
    expected = {
        key: (sum(n for n, _ in runs), round(sum(n * a for n, a in runs) * 0.001, 2))
        for key, runs in by_hour.items()
        if key[0] < last
    }
    got = {(r.bucket_start.hour, r.plan_id): (r.count_executions, r.total_duration) for r in streamed.collect()}
    assert got == expected


def test_folders_lie_below_the_shared_one(spark):
    assert spark.conf.get(CHECKPOINT_DIR, None) in (None, shared_dir(spark))
    assert new_folder(spark, "x").startswith(shared_dir(spark).rstrip("/") + "/x-")
    assert new_folder(spark, "x") != new_folder(spark, "x")


@pytest.mark.parametrize(
    "named, master, expected",
    [("/shared", "yarn", "/shared"), (None, "local[2]", "gaugeworks-app1"), (None, "yarn", None)],
)
def test_only_a_local_session_gets_a_folder_of_its_own(named, master, expected):
    session = SimpleNamespace(
        conf=SimpleNamespace(get=lambda name, default: named),
        sparkContext=SimpleNamespace(master=master, applicationId="app1"),
    )
    if expected is None:
        with pytest.raises(ValueError):
            shared_dir(session)
    else:
        assert shared_dir(session).endswith(expected)

"""Scalar expressions on hand-made edge cases."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gaugeworks.constants import ISOLATION_LEVELS
from gaugeworks.functions import predicates as P
from gaugeworks.functions import scalars as S
from gaugeworks.functions import xml as X
from gaugeworks.operators.sessions import transaction_state
from gaugeworks.sources.event_files import event_glob


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def ts(text):
    return F.lit(text).cast("timestamp")


@pytest.mark.parametrize(
    "ms, text",
    [
        (0, None),
        (None, None),
        (93_784_005, "001 02:03:04.005"),
        (1, "000 00:00:00.001"),
        (86_400_000 * 1234, "234 00:00:00.000"),  # three digits of days, cut on the left
    ],
)
def test_duration_text(spark, ms, text):
    assert value(spark, S.duration_text(F.lit(ms).cast("bigint"))) == text


def test_duration_text_keeps_zero_on_request(spark):
    assert value(spark, S.duration_text(F.lit(0), zero_as_null=False)) == "000 00:00:00.000"


def test_unwrap_ms(spark):
    assert value(spark, S.unwrap_ms(F.lit(-1))) == 4294967293
    assert value(spark, S.unwrap_ms(F.lit(-2147483648))) == 2147483648
    assert value(spark, S.unwrap_ms(F.lit(5))) == 5


@pytest.mark.parametrize(
    "text, start, end, piece",
    [
        ("select 1; select 2", 20, 34, "select 2"),
        ("select 1; select 2", 20, -1, "select 2"),
        ("select 1; select 2", 0, 14, "select 1"),
        ("select 1", 400, 500, "select 1"),  # nothing there: the whole text
        (None, 0, -1, None),
        ("select 1", None, None, "select 1"),
        ("x😀yz", 0, -1, "x😀yz"),
        ("x😀yz", 2, 4, "😀"),
        ("x😀yz", 4, 6, "y"),  # begins inside the pair
        ("x😀yz", 0, 2, "x"),  # ends inside it
        ("x😀yz", 4, 4, "x😀yz"),  # nothing but half a pair: the whole text
        ("😀😀é", 6, -1, "é"),
        ("", 0, -1, ""),
    ],
)
def test_statement_slice(spark, text, start, end, piece):
    column = S.statement_slice(F.lit(text).cast("string"), F.lit(start).cast("int"), F.lit(end).cast("int"))
    assert value(spark, column) == piece


@pytest.mark.parametrize(
    "type_, state, dtc, name",
    [(4, 0, 2, "Prepared"), (1, 7, 0, "Rolling Back"), (None, None, None, None), (4, 2, 9, None), (1, 0, 2, "Invalid")],
)
def test_transaction_state(spark, type_, state, dtc, name):
    columns = [F.lit(x).cast("int") for x in (type_, state, dtc)]
    assert value(spark, transaction_state(*columns)) == name


def test_isolation_level(spark):
    assert value(spark, S.decode_enum(F.lit(3), ISOLATION_LEVELS)) == "Repeatable"
    assert value(spark, S.decode_enum(F.lit(9), ISOLATION_LEVELS)) is None
    assert value(spark, S.decode_enum(F.lit(None).cast("int"), ISOLATION_LEVELS)) is None


def test_boundary_diff_counts_boundaries(spark):
    a, b = ts("2024-01-01 10:00:00.9"), ts("2024-01-01 10:00:01.1")
    assert value(spark, S.boundary_diff("second", a, b)) == 1
    assert value(spark, S.boundary_diff("second", b, a)) == -1
    assert value(spark, S.boundary_diff("minute", a, b)) == 0
    assert value(spark, S.boundary_diff("hour", ts("2024-01-01 10:59:59"), ts("2024-01-01 11:00:00"))) == 1


def test_weekday(spark):
    assert value(spark, S.weekday_name(ts("2024-01-07 00:00:00"))) == "Sunday"
    assert value(spark, S.weekday_no(ts("2024-01-07 00:00:00"))) == 1


def test_hour_bucket_in_a_half_hour_zone(spark):
    start, end = S.hour_bucket(ts("2024-01-01 10:45:00"), "Asia/Kolkata")
    assert value(spark, start) == datetime(2024, 1, 1, 15, 30)
    assert value(spark, end) == datetime(2024, 1, 1, 16, 30)


def test_window_bounds(spark):
    start, end = S.window_bounds("2024-01-01 10:45:00", window=-2, hours_back=-3)
    assert value(spark, end) == datetime(2024, 1, 1, 8)
    assert value(spark, start) == datetime(2024, 1, 1, 5)


def test_round_dec(spark):
    assert value(spark, S.round_dec(F.lit(1.005), 2)) == 1.01
    assert value(spark, S.round_dec(F.lit(-2.675), 2)) == -2.68
    assert value(spark, S.round_dec(F.lit(1e35), 2)) == 1e35
    assert value(spark, S.round_dec(F.lit(None).cast("double"), 2)) is None


def test_division(spark):
    assert value(spark, S.int_div(F.lit(-7), 2)) == -3
    assert value(spark, S.int_div(F.lit(7), 0)) is None
    assert value(spark, S.pct(F.lit(1), F.lit(0))) is None
    assert value(spark, S.pct(F.lit(1), F.lit(4))) == 25.0
    assert value(spark, S.clamp0(F.lit(-3))) == 0
    assert value(spark, S.clamp0(F.lit(None).cast("int"))) == 0


def test_sizes(spark):
    assert value(spark, S.pages_to_mb(F.lit(64))) == 0.5
    assert value(spark, S.pages_to_kb(F.lit(64))) == 512
    assert value(spark, S.pages_text_mb(F.lit(1))) == "0.01 MB"
    assert value(spark, S.pages_text_mb(F.lit(200))) == "1.56 MB"
    assert value(spark, S.pages_text_kb(F.lit(3))) == "24 KB"


def test_names(spark):
    assert value(spark, S.quote_name(F.lit("a]b"))) == "[a]]b]"
    assert value(spark, S.blank_to_null(F.lit(""))) is None
    assert S.parse_name("db.dbo.t", 3) == "db"
    assert S.parse_name("[my.db]..[t 1]", 3) == "my.db"
    assert S.parse_name("[my.db]..[t 1]", 1) == "t 1"
    assert S.parse_name("dbo.t", 3) is None
    assert S.parse_name("a..t", 2) is None
    assert S.dir_of(r"D:\log\x.xel") == "D:\\log\\"
    assert S.dir_of("/var/log/x") == "/var/log/"
    assert S.dir_of("x") == ""


def test_event_glob():
    assert event_glob(r"D:\log\x_0_1.xel", "x.xel") == r"D:\log\x*.xel"
    assert event_glob(r"D:\log\x_0_1.xel", "x") == r"D:\log\x*"


def test_server_time(spark):
    assert value(spark, S.to_server_time(ts("2024-01-01 10:00:00"), -90)) == datetime(2024, 1, 1, 8, 30)
    shifted = S.to_server_time(ts("2024-01-01 10:00:00"), timedelta(hours=2))
    assert value(spark, shifted) == datetime(2024, 1, 1, 12)


def test_predicates(spark):
    bounds = ts("2024-01-01 10:00:00"), ts("2024-01-01 11:00:00")
    inside = P.overlaps(ts("2024-01-01 09:00:00"), ts("2024-01-01 10:00:00"), *bounds)
    before = P.overlaps(ts("2024-01-01 09:00:00"), ts("2024-01-01 09:59:59"), *bounds)
    open_ended = P.overlaps(ts("2024-01-01 09:00:00"), ts(None), *bounds)
    assert [value(spark, c) for c in (inside, before, open_ended)] == [True, False, None]
    flags = spark.createDataFrame([("a", True), ("b", False), (None, None)], "name string, flag boolean")
    assert flags.filter(P.optional_eq("name", None)).count() == 2
    assert flags.filter(P.optional_eq("name", "a")).count() == 1
    assert [flags.filter(P.flag_in("flag", x)).count() for x in (False, True)] == [1, 2]
    assert value(spark, P.since(ts("2024-01-05 00:00:00"), "2024-01-10 13:00:00", 5))
    assert not value(spark, P.since(ts("2024-01-04 23:59:59"), "2024-01-10 13:00:00", 5))


def test_require(spark):
    rows = spark.range(3)
    on, off = (spark.createDataFrame([(s,)], "actual_state int") for s in (2, 1))
    assert P.require(rows, on, F.col("actual_state") == 2).count() == 3
    assert P.require(rows, off, F.col("actual_state") == 2).count() == 0
    keyed = rows.withColumn("instance_id", F.concat(F.lit("i"), F.col("id")))
    states = spark.createDataFrame([("i0", 2), ("i1", 1)], "instance_id string, actual_state int")
    kept = P.require(keyed, states, F.col("actual_state") == 2, ["instance_id"])
    assert [r.id for r in kept.collect()] == [0]


EVENT = (
    '<event name="deprecation_announcement" timestamp="2024-01-01T10:45:00.123Z">'
    '<data name="feature"><value>F1 &lt;x&gt;</value></data><data name="feature"><value>second</value></data>'
    '<action name="session_id"><value>51</value></action><action name="database_id"><value>x</value></action></event>'
)


def test_xml_items(spark):
    event = X.event_struct(F.lit(EVENT))
    assert value(spark, X.xml_item(event, "data", "feature")) == "F1 <x>"
    assert value(spark, X.xml_item(event, "action", "session_id", "int")) == 51
    assert value(spark, X.xml_item(event, "action", "database_id", "int")) is None
    assert value(spark, X.xml_item(event, "action", "absent")) is None
    assert value(spark, X.event_time(event)) == datetime(2024, 1, 1, 10, 45, 0, 123000)
    broken = X.event_struct(F.lit("<event"))
    assert value(spark, X.xml_item(broken, "data", "feature")) is None
    with pytest.raises(ValueError):
        X.xml_item(event, "attribute", "x")


def test_xml_nodes(spark):
    inside = '<deadlock id="d1"><victim/></deadlock><deadlock id="d2"/><deadlock-list/>'
    text = f'<event><note>{inside}</note><data name="a>b"><value>{inside}</value></data><data><text>{inside}</text></data></event>'
    assert value(spark, X.nodes(F.lit(text), "deadlock")) == [
        '<deadlock id="d1"><victim/></deadlock>',
        '<deadlock id="d2"/>',
    ]
    assert value(spark, X.nodes(F.lit("<v/>"), "deadlock")) == []


def test_list_to_xml(spark):
    entries = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(t).alias("t")) for i, t in ((1, "a<b"), (2, None))])
    assert (
        value(spark, X.list_to_xml(entries, "thread", "threads"))
        == "<threads><thread><i>1</i><t>a&lt;b</t></thread><thread><i>2</i></thread></threads>"
    )
    assert value(spark, X.list_to_xml(F.slice(entries, 1, 0), "thread")) is None

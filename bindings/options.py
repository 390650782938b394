"""Options of the reports and parts no other query shows, with the equivalent SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.functions import predicates as P
from gaugeworks.operators import events, replicas, statistics, storage, workload
from gaugeworks.plans.materialize import materialize, new_folder
from gaugeworks.plans.relational import disjunctive_join, numbered, union_all
from gaugeworks.sources.tables import load, save
from bindings.replicas import ORACLE as REPLICA_SQL
from bindings.storage import ORACLE as STORAGE_SQL
from bindings.storage import quoted
from bindings.tables import Bound
from bindings.workload import AS_OF, HOURS_BACK, top_sql

OBJECT = 5
SHIFT = 1_000_000
CAPTURED = "case plan_id % 3 when 0 then timestamp '2024-05-01 23:59:59' when 1 then timestamp '2024-05-02 00:00:00' else timestamp '2024-05-03 12:00:00' end"
GROUP = "AG NATION_11"


def _top(**options):
    def query(b):
        inputs = (b.runtime_stats, b.plans, b.queries, b.texts, b.workload_objects)
        return workload.top_queries(*inputs, as_of=AS_OF, hours_back=HOURS_BACK, **options)

    return query


def _resolve(b) -> DataFrame:
    """The same name on two servers, where its object has another id."""
    one = b.objects.filter(F.col("object_id") == OBJECT).join(b.schemas.withColumnRenamed("name", "schema_name"), "schema_id").first()
    name = ".".join("[" + part.replace("]", "]]") + "]" for part in (one["schema_name"], one["name"]))
    both = lambda df, *ids: union_all(
        df.withColumn("instance_id", F.lit("first")),
        df.withColumns({"instance_id": F.lit("second"), **{c: F.col(c) + SHIFT for c in ids}}),
    )
    found = storage.resolve_object(
        both(b.objects, "object_id"),
        both(b.schemas),
        both(b.internal_tables, "object_id", "parent_id"),
        name,
        "db",
        "dbo",
        ["instance_id"],
    )
    return found.select("instance_id", "object_id")


def _one_object(b) -> DataFrame:
    return storage.space_by_object(
        b.partition_stats, b.internal_tables, b.objects, b.schemas, b.partitions, object_id=OBJECT, system_objects=True
    )


def _staleness(b) -> DataFrame:
    return statistics.statistics_staleness(b.objects, b.schemas, b.stats, b.partition_stats, b.incremental_props, b.stats_props)


def _one_group(b) -> DataFrame:
    return replicas.replica_latency(b.groups, b.replicas, b.db_cluster_states, b.replica_states, b.db_replica_states, group=GROUP)


def _not_met(b) -> DataFrame:
    off = (F.col("name") == "max server memory (MB)") & (F.col("value_in_use") < 0)
    return P.require(b.runtime_stats, b.configurations, off).agg(F.count("*").alias("records"))


def _capture_off(b) -> DataFrame:
    options = b.region.select(F.lit(0).alias("actual_state"))
    return _top(capture_options=options)(b).agg(F.count("*").alias("rows"))


def _mixed_keys(b) -> DataFrame:
    """Fractional keys against whole ones, and each branch with its own condition."""
    left = b.lineitem.select("l_orderkey", F.col("l_quantity").alias("a"), F.col("l_tax").alias("b"))
    right = b.region.select(F.explode(F.array(F.lit(1), F.lit(7), F.lit(30))).alias("k"), "r_regionkey")
    return disjunctive_join(left, right, [("a", "k", F.col("r_regionkey") == 0), ("b", "k", F.col("r_regionkey") == 1)])


def _all_documents(b) -> DataFrame:
    return events.raw_events(b.raw_events.select("object_name", "event_data"), n=None)


def _saved(b) -> DataFrame:
    spark = b.runtime_stats.sparkSession
    folder = new_folder(spark, "tables")
    save(b.runtime_stats, folder, "runtime_stats")
    return load(spark, folder, "runtime_stats").select(*b.runtime_stats.columns)


def _saved_dates(b) -> DataFrame:
    """Snapshots of three days, saved as they come, of which two are read."""
    spark = b.runtime_stats.sparkSession
    folder = new_folder(spark, "tables")
    taken = b.runtime_stats.withColumns({"instance_id": F.lit("one"), "captured_at": F.expr(CAPTURED)})
    for k in range(3):
        save(taken.filter(F.col("plan_id") % 3 == k), folder, "runtime_stats", by_date=True, mode="append")
    return load(spark, folder, "runtime_stats", fleet=True, dates=("2024-05-02", "2024-05-03")).select(*taken.columns)


def _work_table(b) -> DataFrame:
    """One work table, read by three reports in a run."""
    work = materialize(storage.rowgroup_workset(b.tables, b.schemas, b.indexes, b.partitions, b.row_groups))
    reports = {
        "detail": (storage.rowgroup_detail(work), "total_rows"),
        "rollup": (storage.rowgroup_rollup(work), "ci_total_rows"),
        "fragments": (storage.rowgroup_fragments(work, full_rows=2), "fragments"),
    }
    shown = [df.select(F.lit(name).alias("report"), "table_name", "index_name", F.col(c).cast("bigint").alias("n")) for name, (df, c) in reports.items()]
    return union_all(*shown)


def _space_order(b) -> DataFrame:
    report = storage.space_by_object(b.partition_stats, b.internal_tables, b.objects, b.schemas, b.partitions, system_objects=True)
    return numbered(report).select("schema_name", "name", "partition_number", "place")


def _top_order(b) -> DataFrame:
    return numbered(_top(rank_by="total")(b)).select("query_id", "plan_id", "bucket_start", "place")


def _allocation_order(b) -> DataFrame:
    report = storage.allocations(b.tables, b.schemas, b.indexes, b.partitions, b.row_groups, b.allocation_units)
    # equal rows may stand in any order, so places are given per object
    places = numbered(report).groupBy("object_name").agg(F.min("place").alias("first"), F.max("place").alias("last"))
    return numbered(places.orderBy("first")).select("object_name", "place", (F.col("last") - F.col("first") + 1).alias("n"))


BOUND = {
    "a01_one_type": _top(execution_type=0),
    "a01_two_plans": _top(min_plans=2),
    "a01_rowcount": _top(metric="rowcount", rank_by="max"),
    "a01_kolkata": _top(tz="Asia/Kolkata"),
    "v02_resolve_object": _resolve,
    "a24_one_object": _one_object,
    "a29_defaults": _staleness,
    "a20_one_group": _one_group,
    "p10_off": _not_met,
    "p10_capture_off": _capture_off,
    "j07_mixed_keys": _mixed_keys,
    "a16_all_documents": _all_documents,
    "s01_saved_dates": _saved_dates,
    "s01_saved_table": _saved,
    "s06_work_table": _work_table,
    "o04_space_order": _space_order,
    "o05_top_order": _top_order,
    "o07_allocation_order": _allocation_order,
}


def _registered(query):
    return lambda spark, sf_dir: query(Bound(spark, sf_dir))


QUERIES = {name: _registered(query) for name, query in BOUND.items()}

_TOP = top_sql("total")
_SPACE = STORAGE_SQL["a24_space_by_object"]
_PLAIN_OBJECTS = "from (select * from objects where not is_ms_shipped) o"
_PLAIN_STATS = "join (select * from stats where not auto_created) s"

ORACLE = {
    "a01_one_type": top_sql("total", "and rs.execution_type = 0"),
    "a01_two_plans": top_sql("total", min_plans=2),
    "a01_rowcount": top_sql("max", metric="rowcount"),
    "a01_kolkata": f"""
    select * replace (bucket_start + interval 330 minute as bucket_start, bucket_end + interval 330 minute as bucket_end)
      from ({_TOP})""",
    "v02_resolve_object": f"""
    select 'first' as instance_id, object_id from objects where object_id = {OBJECT}
    union all
    select 'second', object_id + {SHIFT} from objects where object_id = {OBJECT}""",
    "a24_one_object": f"{_SPACE} where p.object_id = {OBJECT}",
    "a29_defaults": STORAGE_SQL["a29_statistics_staleness"].replace("from objects o", _PLAIN_OBJECTS).replace("join stats s", _PLAIN_STATS),
    "a20_one_group": f"select * from ({REPLICA_SQL['a20_replica_latency']}) where group_name = '{GROUP}'",
    "p10_off": "select cast(0 as bigint) as records",
    "p10_capture_off": "select cast(0 as bigint) as rows",
    "j07_mixed_keys": """
    select l.l_orderkey, l.l_quantity as a, l.l_tax as b, k.k, cast(r.r_regionkey as bigint) as r_regionkey
      from lineitem l
      join region r on r.r_regionkey in (0, 1)
      join (values (1), (7), (30)) k(k) on k.k = case when r.r_regionkey = 0 then l.l_quantity else l.l_tax end""",
    "a16_all_documents": "select event_data from raw_events",
    "s01_saved_table": "select * from runtime_stats",
    "s01_saved_dates": f"select *, 'one' as instance_id, {CAPTURED} as captured_at from runtime_stats where plan_id % 3 > 0",
    "s06_work_table": f"""
    select 'detail' as report, table_name, index_name, cast(total_rows as bigint) as n from ({STORAGE_SQL['a26_rowgroup_detail']})
    union all
    select 'rollup', table_name, index_name, ci_total_rows from ({STORAGE_SQL['a27_rowgroup_rollup']})
    union all
    select 'fragments', table_name, index_name, fragments from ({STORAGE_SQL['a28_rowgroup_fragments']})""",
    "o04_space_order": f"""
    select {quoted('s.name')} as schema_name, {quoted('o.name')} as name, t.partition_number,
           row_number() over (order by t.pages desc, t.object_id, t.partition_number) as place
      from (select coalesce(own.object_id, 0) as object_id, own.partition_number, own.pages + coalesce(sum(k.reserved_page_count), 0) as pages
              from (select object_id, partition_number, sum(reserved_page_count) as pages from partition_stats group by all) own
              left join internal_tables it on it.parent_id = own.object_id
               and it.internal_type in (202, 204, 211, 212, 213, 214, 215, 216)
              left join partition_stats k on k.object_id = it.object_id and k.partition_number = own.partition_number
             group by own.object_id, own.partition_number, own.pages) t
      join objects o on o.object_id = t.object_id
      left join schemas s on s.schema_id = o.schema_id""",
    "o05_top_order": f"""
    select query_id, plan_id, bucket_start,
           row_number() over (order by rank_value desc nulls last, query_id, bucket_start, plan_id) as place
      from ({top_sql('total', extra_column='b.rank_value')})""",
    "o07_allocation_order": f"""
    select object_name, dense_rank() over (order by object_name nulls first) as place, count(*) as n
      from ({STORAGE_SQL['a25_allocations']}) group by object_name""",
}

"""Workload reports over the test data, with the equivalent SQL."""

from __future__ import annotations

from gaugeworks.constants import METRIC_SCALES
from gaugeworks.functions.predicates import overlaps
from gaugeworks.functions.summaries import merge_summary
from gaugeworks.operators import workload
from bindings.tables import Bound

AS_OF, HOURS_BACK = "2024-01-31 00:00:00", -720
WINDOW = (
    "first_execution_time <= timestamp '2024-01-31 00:00:00' "
    "and last_execution_time >= timestamp '2024-01-01 00:00:00'"
)


def _inputs(spark, sf_dir):
    b = Bound(spark, sf_dir)
    return b.runtime_stats, b.plans, b.queries, b.texts, b.workload_objects


def _top(**options):
    return lambda spark, sf_dir: workload.top_queries(
        *_inputs(spark, sf_dir), as_of=AS_OF, hours_back=HOURS_BACK, **options
    )


def _aborted(spark, sf_dir):
    return workload.aborted_queries(*_inputs(spark, sf_dir), as_of=AS_OF, hours_back=HOURS_BACK)


def _all_metrics(spark, sf_dir):
    return workload.workload_buckets(*_inputs(spark, sf_dir), as_of=AS_OF, hours_back=HOURS_BACK)


def _overlap(spark, sf_dir):
    from pyspark.sql import functions as F

    start, end = F.lit("2024-01-10 00:00:00").cast("timestamp"), F.lit("2024-01-20 00:00:00").cast("timestamp")
    stats = Bound(spark, sf_dir).runtime_stats
    return stats.groupBy("plan_id").agg(
        F.count_if(overlaps("first_execution_time", "last_execution_time", start, end)).alias("inside"),
        F.count("*").alias("records"),
    )


def _merge(spark, sf_dir):
    from pyspark.sql import functions as F

    stats = Bound(spark, sf_dir).runtime_stats
    return stats.groupBy("execution_type_desc", F.date_trunc("day", "last_execution_time").alias("day")).agg(
        *merge_summary("duration"), *merge_summary("log_bytes_used")
    )


QUERIES = {
    "a01_top_total": _top(rank_by="total"),
    "a02_top_avg": _top(rank_by="avg"),
    "a03_top_min": _top(rank_by="min"),
    "a04_top_max": _top(rank_by="max"),
    "a05_top_stdev": _top(rank_by="stdev"),
    "a06_aborted": _aborted,
    "a07_all_metrics": _all_metrics,
    "p03_overlap": _overlap,
    "g04_merge_summary": _merge,
}


def rounded(x: str, digits: int = 2) -> str:
    return f"cast(round(cast({x} as decimal(38,9)), {digits}) as double)"


def merged(m: str) -> str:
    s = METRIC_SCALES[m]
    n, total = "sum(rs.count_executions)", f"sum(rs.avg_{m} * rs.count_executions)"
    pooled = f"sqrt(sum(rs.stdev_{m} * rs.stdev_{m} * rs.count_executions) / nullif({n}, 0))"
    return ", ".join(
        [
            f"{rounded(f'{total} * {s}')} as total_{m}",
            f"{rounded(f'{total} / nullif({n}, 0) * {s}')} as avg_{m}",
            f"{rounded(f'cast(min(rs.min_{m}) as double) * {s}')} as min_{m}",
            f"{rounded(f'cast(max(rs.max_{m}) as double) * {s}')} as max_{m}",
            f"{rounded(f'{pooled} * {s}')} as stdev_{m}",
            f"coalesce({rounded(f'{pooled} * {n} / nullif({total}, 0)')}, 0) as variation_{m}",
        ]
    )


RANKS = {
    "total": "sum(rs.avg_duration * rs.count_executions) * 0.001",
    "avg": "sum(rs.avg_duration * rs.count_executions) / nullif(sum(rs.count_executions), 0) * 0.001",
    "min": "cast(min(rs.min_duration) as double) * 0.001",
    "max": "cast(max(rs.max_duration) as double) * 0.001",
    "stdev": "sqrt(sum(rs.stdev_duration * rs.stdev_duration * rs.count_executions) "
    "/ nullif(sum(rs.count_executions), 0)) * 0.001",
}


def top_sql(rank_by: str, extra: str = "", metric: str = "duration", min_plans: int = 1, extra_column: str = "") -> str:
    rank = RANKS[rank_by].replace("duration", metric).replace("0.001", str(METRIC_SCALES[metric]))
    shown = f", {extra_column}" if extra_column else ""
    return f"""
    with base as (
      select p.query_id, t.query_sql_text, q.object_id, {rounded(rank)} as rank_value
        from runtime_stats rs
        join plans p on p.plan_id = rs.plan_id
        join queries q on q.query_id = p.query_id
        join texts t on t.query_text_id = q.query_text_id
       where {WINDOW} {extra}
       group by p.query_id, t.query_sql_text, q.object_id
      having count(distinct p.plan_id) >= {min_plans}
       order by rank_value desc nulls last, p.query_id limit 25)
    select b.query_id, k.*, b.query_sql_text, p.query_plan, coalesce(o.name, '') as object_name{shown}
      from base b
      join plans p on p.query_id = b.query_id
      join (select rs.plan_id, rs.execution_type_desc as execution_type,
                   cast(sum(rs.count_executions) as bigint) as count_executions,
                   date_trunc('hour', rs.last_execution_time) as bucket_start,
                   date_trunc('hour', rs.last_execution_time) + interval 1 hour as bucket_end,
                   {merged(metric)}
              from runtime_stats rs where {WINDOW} {extra}
             group by rs.plan_id, rs.execution_type_desc, date_trunc('hour', rs.last_execution_time)) k
        on k.plan_id = p.plan_id
      left join workload_objects o on o.object_id = b.object_id"""


ORACLE = {
    **{
        f"a0{i}_top_{rank}": top_sql(rank)
        for i, rank in enumerate(("total", "avg", "min", "max", "stdev"), start=1)
    },
    "a06_aborted": top_sql("total", "and rs.execution_type = 3"),
    "a07_all_metrics": f"""
    select p.query_id, k.*, t.query_sql_text, p.query_plan, coalesce(o.name, '') as object_name
      from (select rs.plan_id, rs.execution_type_desc as execution_type,
                   cast(sum(rs.count_executions) as bigint) as count_executions,
                   date_trunc('hour', rs.last_execution_time) as bucket_start,
                   date_trunc('hour', rs.last_execution_time) + interval 1 hour as bucket_end,
                   {", ".join(merged(m) for m in METRIC_SCALES)}
              from runtime_stats rs where {WINDOW}
             group by rs.plan_id, rs.execution_type_desc, date_trunc('hour', rs.last_execution_time)) k
      join plans p on p.plan_id = k.plan_id
      join queries q on q.query_id = p.query_id
      join texts t on t.query_text_id = q.query_text_id
      left join workload_objects o on o.object_id = q.object_id""",
    "p03_overlap": """
    select plan_id, count(*) as records,
           count(case when not (first_execution_time > timestamp '2024-01-20 00:00:00'
                                or last_execution_time < timestamp '2024-01-10 00:00:00') then 1 end) as inside
      from runtime_stats group by plan_id""",
    "g04_merge_summary": f"""
    select rs.execution_type_desc, date_trunc('day', rs.last_execution_time) as day,
           {merged("duration")}, {merged("log_bytes_used")}
      from runtime_stats rs group by rs.execution_type_desc, date_trunc('day', rs.last_execution_time)""",
}

"""Relational building blocks: joins, top-k, ranked rows, lookups and nested lists."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DecimalType, DoubleType, IntegralType, LongType, NumericType

from gaugeworks.functions.predicates import as_column
from gaugeworks.plans.materialize import stored

BROADCAST_ROWS = 500_000


# joins


def lookup(df: DataFrame, dim: DataFrame, on: Sequence[str] | str, how: str = "left") -> DataFrame:
    """Equi-join to a keyed table. ``left`` keeps rows without a match, ``inner`` drops them.

    No hint is given: Spark broadcasts the table when its measured size allows it and otherwise
    shuffles both sides, splitting a hot key of ``df``.
    """
    return df.join(dim, [on] if isinstance(on, str) else list(on), how)


def lookup_one(df: DataFrame, dim: DataFrame, on: Sequence[str], value: str, how: str = "left") -> DataFrame:
    """Lookup of one value per key; several candidates give the smallest."""
    return lookup(df, dim.groupBy(*on).agg(F.min(value).alias(value)), on, how)


def first_match(
    df: DataFrame,
    candidates: Sequence[tuple[DataFrame, Sequence[str], str]],
    alias: str,
    default: Column | None = None,
) -> DataFrame:
    """The first value found in a list of ``(table, keys, column)`` lookups, else the default."""
    found = []
    for i, (dim, on, column) in enumerate(candidates):
        name = f"_{alias}_{i}"
        df = lookup_one(df, dim.withColumnRenamed(column, name), on, name)
        found.append(F.col(name))
    if default is not None:
        found.append(default)
    return df.withColumn(alias, F.coalesce(*found)).drop(*[f"_{alias}_{i}" for i in range(len(candidates))])


def fits_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` has at most ``max_rows`` rows. ``df`` should already be materialized.

    Every task counts its own rows and sends one number.
    """
    return df.count() <= max_rows


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint only for a table that fits; beyond that the join is left to a shuffle."""
    return F.broadcast(df) if fits_broadcast(df, max_rows) else df


def left_join_many(
    left: DataFrame, right: DataFrame, on: Sequence[str], parents: DataFrame | None = None, held: DataFrame | None = None
) -> DataFrame:
    """Left join to a table that may hold very many rows for one key.

    Adaptive execution splits a hot key on both sides of an inner join, but never on the right side
    of a left join. So ``right`` first gets an empty row for every key of ``left`` that it lacks, and
    an inner join does the rest. Which keys it lacks is one aggregate over the keys of both, combined on
    the map side. ``parents`` is a cheap table that has all keys of ``left``, and may have others; ``held`` is
    one that has just the keys of ``right``. Keys must not be NULL.
    """
    on = list(on)
    wanted = (left if parents is None else parents).select(*on, F.lit(False).alias("_held"))
    both = wanted.unionByName((right if held is None else held).select(*on, F.lit(True).alias("_held")))
    lacking = both.groupBy(*on).agg(F.max("_held").alias("_held")).filter("NOT _held").select(*on)
    return left.join(right.unionByName(lacking, allowMissingColumns=True), on)


def disjunctive_join(
    left: DataFrame, right: DataFrame, branches: Sequence[tuple[str, str, Column]], keys=()
) -> DataFrame:
    """Join on ``(left.a = right.k AND c1) OR (left.b = right.k AND c2) OR ...``.

    Each branch is ``(left column, right column, condition on the right row)`` and the conditions
    exclude one another. A right row gets the number of its branch, a left row appears once per
    branch, and one equi-join on (branch, value) does the rest: each table is read and shuffled
    once, where the plain OR would compare every pair. Values keep their type when all columns have the
    same; numbers of several types meet in the widest, and other mixtures are an error.
    """
    kind = _common_type([left.schema[a].dataType for a, _, _ in branches] + [right.schema[b].dataType for _, b, _ in branches])
    number = reduce(
        lambda acc, b: acc.when(b[1][2], F.lit(b[0])),
        enumerate(branches),
        F.when(F.lit(False), F.lit(0)),
    )
    value = reduce(
        lambda acc, b: acc.when(b[1][2], F.col(b[1][1]).cast(kind)),
        enumerate(branches),
        F.when(F.lit(False), F.lit(None).cast(kind)),
    )
    tags = F.array(
        *[
            F.struct(F.lit(i).alias("_branch"), F.col(column).cast(kind).alias("_value"))
            for i, (column, _, _) in enumerate(branches)
        ]
    )
    tagged_left = left.select("*", F.inline(tags)).filter("_value IS NOT NULL")
    tagged_right = right.withColumn("_branch", number).withColumn("_value", value).filter("_branch IS NOT NULL")
    return tagged_left.join(tagged_right, [*keys, "_branch", "_value"]).drop("_branch", "_value")


def _common_type(kinds: list[DataType]) -> DataType:
    """One type that holds the values of all of ``kinds`` as they are."""
    if len(set(kinds)) == 1:
        return kinds[0]
    if all(isinstance(k, IntegralType) for k in kinds):
        return LongType()
    if all(isinstance(k, (IntegralType, DecimalType)) for k in kinds):
        scale = max(k.scale for k in kinds if isinstance(k, DecimalType))
        return DecimalType(38, scale)
    if all(isinstance(k, NumericType) for k in kinds):
        return DoubleType()
    raise ValueError(f"keys of different kinds can't be compared: {', '.join(sorted({k.simpleString() for k in kinds}))}")


def flag_parents(df: DataFrame, children: DataFrame, id_: str, parent: str, alias: str, keys=()) -> DataFrame:
    """Mark the rows some child points to; each row stays single however many children it has."""
    parents = (
        children.select(*keys, F.col(parent).alias(id_)).filter(F.col(id_).isNotNull()).distinct()
    ).withColumn(alias, F.lit(True))
    return df.join(parents, [*keys, id_], "left").withColumn(alias, F.coalesce(alias, F.lit(False)))


def with_scalar(df: DataFrame, one_row: DataFrame, column: str, keys=()) -> DataFrame:
    """Add the value of a one-row table: per snapshot with ``keys``, else as a scalar subquery."""
    if keys:
        return df.join(one_row.select(*keys, column), list(keys), "left")
    return df.withColumn(column, one_row.select(column).scalar())


def merge_totals(parts: Iterable[DataFrame], keys=()) -> DataFrame:
    """One row per snapshot out of several one-row aggregates with different columns.

    The aggregates are stacked and added up, which needs no cross join when there are no keys.
    """
    stacked = union_all(*parts)
    names = [c for c in stacked.columns if c not in keys]
    return stacked.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in names])


# sets, ranks, top-k


def union_all(*dfs: DataFrame) -> DataFrame:
    """UNION ALL by column name; a column absent on one side is NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def first_per(df: DataFrame, partition: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each group.

    Spark limits each group on the map side before the shuffle, so a hot group arrives as one row
    per task.
    """
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*partition).orderBy(*order)))
    return ranked.filter("_rank = 1").drop("_rank")


def top_k(df: DataFrame, by: Sequence[Column], n: int, keys=()) -> DataFrame:
    """The first ``n`` rows in the given order, per snapshot when there are ``keys``.

    Without keys every task keeps its own best ``n``; with keys the same holds per snapshot. The
    ``n`` rows end in one partition anyway; saying so keeps later columns from being computed for
    all rows ahead of the limit, which would turn it into a full sort.
    """
    if not keys:
        return df.orderBy(*by).limit(n).coalesce(1)
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*by)))
    return ranked.filter(F.col("_rank") <= n).drop("_rank")


def report_order(df: DataFrame, ordered: bool, *by) -> DataFrame:
    """The report's row order; ``ordered=False`` saves the sort when the result is written or joined."""
    return df.orderBy(*by) if ordered else df


def numbered(df: DataFrame, name: str = "place") -> DataFrame:
    """The rows of a sorted ``df`` with their place in it, from 1; rows are numbered where they are.

    A place is the row's own number in its partition plus the rows of all partitions before. The sorted
    rows are written once, so that both counts see the same partitions; what a single task sees is one
    count per partition.
    """
    own_bits = 33  # of a monotonically increasing number, below those of the partition
    held = stored(df.withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_at", own_bits)
    counts = held.groupBy(part.alias("_part")).agg(F.count("*").alias("_rows"))
    ahead = F.sum("_rows").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("_part", F.coalesce(ahead, F.lit(0)).alias("_ahead"))
    inside = F.col("_at").bitwiseAND(F.lit((1 << own_bits) - 1))
    placed = held.join(F.broadcast(counts), part == F.col("_part"))  # a row per partition
    return placed.select(*df.columns, (F.col("_ahead") + inside + 1).alias(name))


# aggregates


def sum_if(condition: Column, value) -> Column:
    """Sum over the rows that meet the condition; NULL when none does."""
    return F.sum(F.when(condition, as_column(value)))


def count_if(condition: Column) -> Column:
    """Count of the rows that meet the condition; NULL when none does."""
    return F.sum(F.when(condition, F.lit(1)))


def conditional_counts(df: DataFrame, by: Sequence[str], conditions: dict[str, Column]) -> DataFrame:
    """Several filtered counts of one table in one pass; an empty class is NULL."""
    return df.groupBy(*by).agg(*[count_if(c).alias(name) for name, c in conditions.items()])


def nest(df: DataFrame, keys: Sequence[str], columns: Sequence[str], order: Sequence[Column | str], alias: str) -> DataFrame:
    """Child rows as one sorted list of structs per parent.

    A name in ``order`` sorts by that column itself, which is then in the moved entries once and not twice.
    A list is one value in one row, so this is for children that are few per parent; where a parent
    may have any number of them, join the child rows instead.
    """
    sort_by = [F.col(c) if isinstance(c, str) else c.alias(f"_{i}") for i, c in enumerate(order)]
    entry = F.struct(*sort_by, *[F.col(c) for c in columns if c not in [o for o in order if isinstance(o, str)]])
    listed = df.groupBy(*keys).agg(F.sort_array(F.collect_list(entry)).alias(alias))
    return listed.withColumn(alias, F.transform(alias, lambda e: F.struct(*[e[c].alias(c) for c in columns])))

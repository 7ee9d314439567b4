"""Running totals over an order, without ever sorting one big group in one task."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankmill.sources.scratch import keep

# Copies of one row that are expanded together in one task.
COPY_BLOCK = 65_536


def _spread_copies(cells: DataFrame, partitions: int, block: int) -> DataFrame:
    """One row per copy with its 1-based ``_copy`` number; big cells are cut to blocks and shuffled apart."""
    last = F.least(F.col("_from") + block, F.col("_copies"))
    numbered = F.explode(F.sequence(F.col("_from") + 1, last)).alias("_copy")
    few = cells.where(F.col("_copies") <= block).withColumn("_from", F.lit(0).cast("bigint"))
    many = (
        cells.where(F.col("_copies") > block)
        .withColumn("_from", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_copies") - 1, F.lit(block))))
        .repartition(partitions, *cells.columns, "_from")
    )
    return few.unionByName(many).select(*cells.columns, numbered)


def running_totals(
    df: DataFrame,
    order_by: Sequence[Column],
    totals: Mapping[str, Column],
    num_partitions: int | None = None,
    block: int = COPY_BLOCK,
) -> DataFrame:
    """Add inclusive running totals of integer weights over the whole table in the given order.

    Exact copies of a row are counted first, so no run of copies can fill one slice; the other columns
    break remaining ties. The cells are range-partitioned by the order, summed inside each slice and
    shifted by the total of the slices before. The slices are written out, so both passes see the same
    boundaries. Columns must be of types Spark can group by.
    """
    partitions = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = list(totals)
    order = [*order_by, *map(F.col, df.columns)]
    cells = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_copies"))
    slices = keep(
        cells.withColumns({f"_w_{name}": weight for name, weight in totals.items()})
        .repartitionByRange(partitions, *order)
        .withColumn("_slice", F.spark_partition_id())
    )
    sums = slices.groupBy("_slice").agg(
        *(F.sum(F.col(f"_w_{name}") * F.col("_copies")).alias(f"_s_{name}") for name in names)
    )
    # Bounded: one row per slice.
    earlier = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sums.select(
        "_slice", *(F.coalesce(F.sum(f"_s_{name}").over(earlier), F.lit(0)).alias(f"_s_{name}") for name in names)
    )
    inside = Window.partitionBy("_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = (
        slices.withColumns(
            {f"_e_{name}": F.sum(F.col(f"_w_{name}") * F.col("_copies")).over(inside) for name in names}
        )
        .join(F.broadcast(shifts), "_slice")
        .select(
            *df.columns,
            "_copies",
            *(f"_w_{name}" for name in names),
            *((F.col(f"_e_{name}") + F.col(f"_s_{name}")).alias(f"_e_{name}") for name in names),
        )
    )
    # A cell's total is that of its last copy.
    after = F.col("_copies") - F.col("_copy")
    return _spread_copies(summed, partitions, block).select(
        *df.columns, *((F.col(f"_e_{name}") - F.col(f"_w_{name}") * after).alias(name) for name in names)
    )


def number_rows(
    df: DataFrame, order_by: Sequence[Column], name: str = "row_no", num_partitions: int | None = None
) -> DataFrame:
    """1-based row number over a total order of the whole table."""
    return running_totals(df, order_by, {name: F.lit(1).cast("bigint")}, num_partitions)


def _offsets(slices: DataFrame, groups: Sequence[str], weights: Mapping[str, Column]) -> DataFrame:
    """(_s, _g, _before_*): what a group has in earlier slices, for groups that go on from one slice to the next.

    Bounded: each slice ends with one group, and lies inside or begins with at most one that ended before.
    """
    group = F.struct(*groups)
    ends = slices.groupBy("_slice").agg(F.max(group).alias("_end")).select("_end").distinct()
    parts = (
        slices.withColumn("_g", group)
        .join(F.broadcast(ends), F.col("_g").eqNullSafe(F.col("_end")))
        .groupBy(F.col("_slice").alias("_s"), "_g")
        .agg(*(F.sum(weight).alias(f"_n_{name}") for name, weight in weights.items()))
    )
    earlier = Window.partitionBy("_g").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    sums = {f"_before_{name}": F.sum(f"_n_{name}").over(earlier) for name in weights}
    found = parts.select("_s", "_g", *(total.alias(name) for name, total in sums.items()))
    return found.where(F.coalesce(*sums).isNotNull())


def group_rank(
    df: DataFrame,
    groups: Sequence[str],
    order_by: Sequence[Column],
    name: str = "rank",
    num_partitions: int | None = None,
) -> DataFrame:
    """Add the 1-based rank of each row inside its group, whatever the size of the group; NULL is a group.

    The rows are range-partitioned by (group, order) and numbered inside (slice, group). Only a group that
    goes on from the slice before needs an offset, so at most two (slice, group) pairs a slice are broadcast.
    ``order_by`` should be total: rows that tie in all of it stay in one slice.
    """
    partitions = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c) for c in groups]
    slices = keep(
        df.repartitionByRange(partitions, *keys, *order_by).withColumn("_slice", F.spark_partition_id()), "slices"
    )
    group = F.struct(*groups)
    offsets = _offsets(slices, groups, {"n": F.lit(1)})
    inside = Window.partitionBy("_slice", *groups).orderBy(*order_by)
    on = (F.col("_slice") == F.col("_s")) & group.eqNullSafe(F.col("_g"))
    return (
        slices.withColumn("_inside", F.row_number().over(inside).cast("bigint"))
        .join(F.broadcast(offsets), on, "left")
        .select(*df.columns, (F.col("_inside") + F.coalesce("_before_n", F.lit(0))).alias(name))
    )


def group_totals(
    df: DataFrame,
    group: str,
    order_by: Sequence[Column],
    totals: Mapping[str, Column],
    num_partitions: int | None = None,
    block: int = COPY_BLOCK,
) -> DataFrame:
    """Inclusive running totals of integer weights inside each group, whatever its size; NULL is a group.

    Works as ``group_rank``, with exact copies of a row counted first as in ``running_totals``, so neither a
    group nor a run of copies meets one task. Columns must be of types Spark can group by.
    """
    partitions = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = list(totals)
    order = [*order_by, *map(F.col, df.columns)]
    cells = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_copies"))
    slices = keep(
        cells.withColumns({f"_w_{name}": weight for name, weight in totals.items()})
        .repartitionByRange(partitions, F.col(group), *order)
        .withColumn("_slice", F.spark_partition_id()),
        "slices",
    )
    weighted = {name: F.col(f"_w_{name}") * F.col("_copies") for name in names}
    offsets = _offsets(slices, [group], weighted)
    inside = Window.partitionBy("_slice", group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    on = (F.col("_slice") == F.col("_s")) & F.struct(group).eqNullSafe(F.col("_g"))
    summed = (
        slices.withColumns({f"_e_{name}": F.sum(weight).over(inside) for name, weight in weighted.items()})
        .join(F.broadcast(offsets), on, "left")
        .select(
            *df.columns,
            "_copies",
            *(f"_w_{name}" for name in names),
            *((F.col(f"_e_{name}") + F.coalesce(f"_before_{name}", F.lit(0))).alias(f"_e_{name}") for name in names),
        )
    )
    after = F.col("_copies") - F.col("_copy")
    return _spread_copies(summed, partitions, block).select(
        *df.columns, *((F.col(f"_e_{name}") - F.col(f"_w_{name}") * after).alias(name) for name in names)
    )


# Rows of a group that one task may sort.
BIG_GROUP = 100_000


def in_groups(
    df: DataFrame,
    group: str,
    small: Callable[[DataFrame], DataFrame],
    big: Callable[[DataFrame], DataFrame],
    limit: int = BIG_GROUP,
) -> DataFrame:
    """``small`` over the rows of groups of at most ``limit`` rows, which meet one task each, and ``big`` over the rest.

    Both must give the same rows for any group; NULL is a group. Groups are counted by partial aggregates first. Without
    a big one, which is known before anything else runs, the result is ``small`` of all rows.
    """
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit)
    large = sizes.select(F.col(group).alias("_large"))
    if large.isEmpty():
        return small(df)
    same = df[group].eqNullSafe(F.col("_large"))
    return small(df.join(large, same, "left_anti")).unionByName(big(df.join(large, same, "left_semi")))


def window_totals(df: DataFrame, group: str, order_by: Sequence[Column], totals: Mapping[str, Column]) -> DataFrame:
    """As ``group_totals``, for groups that one task can sort: several orders of one group share its partition."""
    upto = Window.partitionBy(group).orderBy(*order_by).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({name: F.sum(weight).over(upto) for name, weight in totals.items()})

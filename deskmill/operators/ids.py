"""Running ids and ordinals without one global sort task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deskmill.session import durable

_LOCAL_BITS = 33  # width of the row counter inside monotonically_increasing_id


def assign_ids(
    rows: DataFrame, existing: DataFrame | None, order: list[str], id_col: str = "id"
) -> DataFrame:
    """Number ``rows`` in ``order`` after the highest id of ``existing`` (or from 1).

    A range sort spreads the rows; ids are the rows before the partition plus the
    position within it. The sorted copy is written once, because the two passes
    over it must see the same partition borders. ``order`` must be unique.
    """
    placed = durable(
        rows.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_pos", F.monotonically_increasing_id())
    )
    placed = placed.withColumn("_part", F.shiftright("_pos", _LOCAL_BITS))
    before = (
        placed.groupBy("_part")
        .agg(F.count("*").alias("_rows"))
        .select(
            "_part",
            F.coalesce(
                F.sum("_rows").over(
                    Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
                ),
                F.lit(0),
            ).alias("_before"),
        )
    )
    highest = F.lit(0)
    if existing is not None:
        highest = F.coalesce(existing.agg(F.max(id_col)).scalar(), highest)
    local = F.col("_pos").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1))
    # one row per range partition: safe to broadcast at any table size
    return (
        placed.join(F.broadcast(before), "_part")
        .withColumn(id_col, (highest + F.col("_before") + local + 1).cast("bigint"))
        .drop("_pos", "_part", "_before")
    )


def in_ranges(df: DataFrame, order: list[str]) -> DataFrame:
    """``df`` cut into about equal ranges of ``order``, numbered in that order by ``_range``.

    Written once, because every reader must see the same borders. A key that holds a
    third of the rows, all of them at one instant even, spreads over a third of the ranges.
    """
    return durable(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))


def ordinal(df: DataFrame, key: str, order: list[str], out: str) -> DataFrame:
    """Position of each row within its key, by ``order``.

    Counted per key and range of rows, plus the key's rows in earlier ranges.
    """
    ranged = in_ranges(df, [key, *order])
    before = (
        ranged.groupBy(key, "_range")
        .agg(F.count("*").alias("_rows"))
        .select(
            key,
            "_range",
            F.coalesce(
                F.sum("_rows").over(
                    Window.partitionBy(key)
                    .orderBy("_range")
                    .rowsBetween(Window.unboundedPreceding, -1)
                ),
                F.lit(0),
            ).alias("_before"),
        )
    )
    local: Column = F.row_number().over(Window.partitionBy(key, "_range").orderBy(*order))
    return (
        ranged.withColumn("_local", local)
        .join(before, [key, "_range"])
        .withColumn(out, (F.col("_before") + F.col("_local")).cast("bigint"))
        .drop("_range", "_local", "_before")
    )

"""Places of rows in an order, without a task that sees all rows of a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.session import materialise

#: monotonically_increasing_id() has the partition above this bit, the row in it below.
PARTITION_SHIFT = 33


def numbered(rows: DataFrame, order: list[str | Column], group: str | None = None, name: str = "numbered") -> DataFrame:
    """`rows`, a written table, with `position` (from 0 in `order` within `group`) and `total`, the group's rows.

    Rows are sorted once, dealt by range over (group, order), so that neither a large group nor many ties meet in one task: rows
    equal in all of these are told apart by their place in the table. Only counts per group and partition are added up then.
    Null groups are a group; null keys come where `order` puts them.
    """
    within = F.col(group) if group else F.lit(None).cast("string")
    keyed = rows.select(F.col("*"), within.alias("_group"), F.monotonically_increasing_id().alias("_row"))
    by = ["_group", *order, "_row"]
    placed = materialise(keyed.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()), name)
    placed = placed.withColumn("_part", F.shiftright("_at", PARTITION_SHIFT))
    counts = materialise(placed.groupBy("_group", "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first")), f"{name}-counts")
    whole = Window.partitionBy("_group")
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        F.col("_group").alias("_g"), F.col("_part").alias("_p"), (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_n").over(whole).alias("total")
    )
    found = placed.join(starts, F.col("_group").eqNullSafe(F.col("_g")) & (F.col("_part") == F.col("_p")))
    return found.select(*rows.columns, (F.col("_at") + F.col("_shift")).alias("position"), "total")

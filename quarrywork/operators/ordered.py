"""Running sums and ranks over groups of any size: a sort by ranges, sums inside each range, and what stands before a range added to it.

A group may fill many ranges, and a range holds many groups; only for the groups that began in an earlier range something has to be added, at most one for
each range. So what is broadcast has as many rows as there are ranges, and no task sees more than a range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..shared import settle

RANGE = "_range"


def ranged(rows: DataFrame, group: str, order: list, label: str) -> DataFrame:
    """The rows, written, with the number of the range they are in; ranges follow the group and then the order."""
    return settle(rows.repartitionByRange(F.col(group), *order).withColumn(RANGE, F.spark_partition_id()), label)


def running(rows: DataFrame, group: str, order: list, value: Column, name: str) -> DataFrame:
    """Adds the sum of the values of a group's rows up to each, in order. rows: from `ranged` with the same group and order."""
    own = rows.withColumn("_value", value)
    before = F.sum("_sum").over(Window.partitionBy(group).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1))
    ranges = own.groupBy(group, RANGE).agg(F.sum("_value").alias("_sum")).withColumn("_before", before).filter("_before IS NOT NULL").select(group, RANGE, "_before")
    here = F.sum("_value").over(Window.partitionBy(group, RANGE).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return own.withColumn(name, here).join(F.broadcast(ranges), [group, RANGE], "left").withColumn(name, F.col(name) + F.coalesce("_before", F.lit(0))).drop("_before", "_value")


def placed(rows: DataFrame, group: str, order: list, name: str = "place") -> DataFrame:
    """Adds the place from 1 of each row in its group."""
    return running(ranged(rows, group, order, "ordered-rows"), group, order, F.lit(1).cast("long"), name).drop(RANGE)

"""Exact ranks of groups of any size, by ranges of the order instead of one task a group."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewlake.sources.storage import stored

#: Rows of a range: what one task sorts.
RANGE_ROWS = 500_000


def ranked_by_range(rows: DataFrame, group: list[str], order: list[Column | str], name: str = "rank", range_rows: int = RANGE_ROWS) -> DataFrame:
    """Adds the rank (from 1) of each row in its group, by `order`.

    Spark samples the rows for splitters of (group, order) and deals the rows to ranges between them, so a group of any size lies in
    several ranges. Ranges are counted for each group, what lies in a group's earlier ranges is summed up, and a rank is that sum plus
    the place inside the range. Rows are written before the sampling, so that they aren't made twice, and after it, so that a range
    is the same for counts and rows. Up to range_rows rows there is one range, and nothing is sampled.
    """
    rows = stored(rows, "rows")
    ranges = max(1, math.ceil(rows.count() / range_rows))
    if ranges == 1:
        return rows.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    dealt = stored(rows.repartitionByRange(ranges, *group, *order).withColumn("range", F.spark_partition_id()), "ranges")
    per = dealt.groupBy(*group, "range").agg(F.count("*").alias("size"))
    # A group has as many rows here as it has ranges.
    before = F.sum("size").over(Window.partitionBy(*group).orderBy("range")) - F.col("size")
    inside = F.row_number().over(Window.partitionBy(*group, "range").orderBy(*order))
    met = dealt.join(per.select(*group, "range", before.alias("before")), [*group, "range"])
    return met.withColumn(name, (F.col("before") + inside).cast("int")).select(*rows.columns, name)

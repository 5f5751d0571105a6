"""Numbering all rows of a table in an order, without one task that sees them all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut

_WITHIN = (1 << 33) - 1  # the row's place within its partition, in monotonically_increasing_id


def numbered(df: DataFrame, order: list, name: str = "n") -> DataFrame:
    """The rows with their place from 0 in a total order.

    The order deals rows over range partitions, each is sorted by itself, and every row's place is its place there
    plus the rows of the partitions before. Those counts, one for each partition, are all that reaches the driver."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = cut(ranged.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), "numbered")
    before, offsets = 0, []
    for r in placed.groupBy("_part").count().orderBy("_part").collect():
        offsets.append((r["_part"], before))
        before += r["count"]
    table = F.broadcast(df.sparkSession.createDataFrame(offsets, "_part int, _before bigint"))
    out = placed.join(table, "_part").withColumn(name, F.col("_before") + F.col("_at").bitwiseAND(_WITHIN))
    return out.drop("_part", "_at", "_before")

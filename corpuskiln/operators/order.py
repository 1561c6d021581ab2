"""Dense numbers in a global order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuskiln.session import durable

_ROW = (1 << 33) - 1


def numbered(df: DataFrame, *order: str, into: str = "chunk_ord") -> DataFrame:
    """Adds `into`: 0, 1, 2, … in the order of the columns `order` (nulls first; rows equal in all of them in any order).

    A range-partitioned sort; each partition counts its rows, and only the
    counts, one a partition, are added up in one place.
    """
    columns = [c for c in df.columns if c != into]
    rows = durable(df.select(*columns).repartitionByRange(*order).sortWithinPartitions(*order))
    placed = rows.select("*", F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW)).alias("__row"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("__part").agg(F.count("*").alias("__n")).select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    return placed.join(F.broadcast(starts), "__part").select(*columns, (F.col("__start") + F.col("__row")).alias(into))

"""Places of all rows in a sorted order, without bringing the rows together.

A range sort deals rows to partitions in order and each row keeps where it stands in its partition. Its place is that
plus the number of rows in earlier partitions, a table with a row for each partition and sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..sources.staging import Stages

#: Key of rows without a value, after all others.
LAST = (1 << 63) - 1


def sort_key(value: Column, ascending: bool) -> Column:
    """An integer or date as a long that sorts in the wanted direction, missing values last."""
    number = value.cast("long")
    return F.coalesce(number if ascending else -number, F.lit(LAST))


def keyed(rows: DataFrame, sorts: dict[str, Column], key: str) -> DataFrame:
    """(sort, rank_key, key): every row once for each sort, from one reading of the rows."""
    each = F.array(*(F.struct(F.lit(name).alias("sort"), value.alias("rank_key")) for name, value in sorts.items()))
    return rows.select(F.inline(each), key)


def top_of_each(rows: DataFrame, top: int, key: str) -> DataFrame:
    """The first ``top`` rows of each sort with their place; rows are cut to ``top`` before they are shuffled."""
    order = W.partitionBy("sort").orderBy("rank_key", key)
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top).drop("rank_key")


def place_all(rows: DataFrame, key: str, stages: Stages, name: str = "sorted") -> DataFrame:
    """(sort, key, place) of every row of every sort; ties go to the lesser key."""
    by = ["sort", "rank_key", key]
    dealt = stages.put(name, rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("at", F.monotonically_increasing_id()))
    dealt = dealt.withColumn("part", F.shiftrightunsigned("at", 33))
    runs = dealt.groupBy("sort", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = W.partitionBy("sort").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    runs = runs.select("sort", "part", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("skip"))
    return dealt.join(runs, ["sort", "part"]).select("sort", key, (F.col("at") - F.col("first") + F.col("skip") + 1).alias("place"))

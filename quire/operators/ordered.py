"""Ordered operators that hold when one key has a third of all rows: work in bounded buckets, then a pass over buckets.

A window over a whole key puts all its rows into one task. Here the rows of a key are split by time or by range, each
bucket is worked on alone, and what crosses buckets travels in one small row per bucket.

Defined results: rows with a null key or time are left out; ties are ordered by the tie column; empty tables give
empty tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.session import settle


def last_before(df: DataFrame, key: str, micros: str, hit: Column, value: str, bucket: int, out: str) -> DataFrame:
    """``df`` with ``value`` of the key's latest earlier row where ``hit`` holds: an as-of join of a table with itself.

    ``micros`` is the time as a number; ``bucket`` is the width of a bucket in the same unit."""
    rows = df.where(F.col(key).isNotNull() & F.col(micros).isNotNull()).withColumn("__bucket", F.floor(F.col(micros) / bucket))
    seen = F.when(hit, F.struct(F.col(micros).alias("t"), F.col(value).alias("v")))
    inside = F.max(seen).over(Window.partitionBy(key, "__bucket").orderBy(micros).rangeBetween(Window.unboundedPreceding, -1))
    carried = rows.groupBy(key, "__bucket").agg(F.max(seen).alias("m"))
    before = F.max("m").over(Window.partitionBy(key).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1))
    carried = carried.select(key, "__bucket", before.alias("__before"))
    both = rows.withColumn("__inside", inside).join(carried, [key, "__bucket"])
    return both.withColumn(out, F.coalesce("__inside", "__before")["v"]).drop("__bucket", "__inside", "__before")


def sessions(df: DataFrame, key: str, micros: str, gap: int, bucket: int) -> DataFrame:
    """(key, start, end, n) of the runs of rows of a key that are at most ``gap`` apart.

    Runs are found inside each bucket; those that meet at a border are joined over the few runs per bucket."""
    rows = df.where(F.col(key).isNotNull() & F.col(micros).isNotNull()).select(key, F.col(micros).alias("t"), F.floor(F.col(micros) / bucket).alias("b"))

    def islands(x: DataFrame, parts: list[str], start: str, end: str, n: Column) -> DataFrame:
        w = Window.partitionBy(*parts).orderBy(start, end)
        fresh = F.coalesce((F.col(start) - F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1)) > gap).cast("int"), F.lit(1))
        numbered = x.withColumn("fresh", fresh).withColumn("i", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        return numbered.groupBy(*parts, "i").agg(F.min(start).alias("start"), F.max(end).alias("end"), n.alias("n"))

    inside = islands(rows.withColumn("e", F.col("t")), [key, "b"], "t", "e", F.count("*"))
    return islands(inside.select(key, "start", "end", "n"), [key], "start", "end", F.sum("n")).select(key, "start", "end", "n")


def numbered(df: DataFrame, group: str, order: list[str], out: str) -> DataFrame:
    """``df`` with the number, from 1, of each row within its group in the given order.

    Ranges over (group, order) split a large group over many tasks; each range's rows are numbered alone and shifted
    by the sizes of the group's earlier ranges. The ranges are written down first, so they stay the same."""
    ranged = settle(df.repartitionByRange(*[F.col(c) for c in (group, *order)]).withColumn("__part", F.spark_partition_id()))
    sizes = ranged.groupBy(group, "__part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select(F.col(group).alias("__group"), F.col("__part").alias("__range"), F.coalesce(before, F.lit(0)).alias("__shift"))
    inside = F.row_number().over(Window.partitionBy(group, "__part").orderBy(*order))
    joined = ranged.withColumn("__inside", inside).join(sizes, F.col(group).eqNullSafe(F.col("__group")) & (F.col("__part") == F.col("__range")))
    return joined.withColumn(out, (F.col("__inside") + F.col("__shift")).cast("long")).drop("__part", "__inside", "__group", "__range", "__shift")

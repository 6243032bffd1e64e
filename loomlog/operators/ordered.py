"""Ordered work within keys of any size: numbering, running counts, and the last or next value, without one task per key.

A key may hold a third of all rows. Where an order is already numbered (seq), rows are handled in chunks of CHUNK numbers, and
what a chunk needs from the others is found among one row per key and chunk. Where it isn't, numbered() first ranges the rows
over the tasks. Null keys form a key of their own; ties in the order are broken by the columns given last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 65_536


def _same(a: DataFrame, b: DataFrame, names: list[str]) -> Column:
    condition = F.lit(True)
    for n in names:
        condition = condition & a[n].eqNullSafe(b[n])
    return condition


def numbered(df: DataFrame, keys: list[str], order: list[Column], name: str, keep) -> DataFrame:
    """Adds the 0-based position of each row within its key. keep(df, name) stores the ranged rows."""
    ranged = keep(df.repartitionByRange(*[F.col(k).asc_nulls_first() for k in keys], *order).withColumn("_part", F.spark_partition_id()), "ranged")
    within = Window.partitionBy("_part", *keys).orderBy(*order)
    sizes = ranged.groupBy("_part", *keys).count()
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("_part", *keys, F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_base"))
    rows = ranged.withColumn("_at", F.row_number().over(within) - 1)
    joined = rows.join(bases, _same(rows, bases, ["_part", *keys]), "left")
    return joined.select(*[rows[c] for c in df.columns], (F.col("_base") + F.col("_at")).cast("long").alias(name))


def _chunked(df: DataFrame, seq: str) -> DataFrame:
    return df.withColumn("_chunk", F.floor(F.col(seq) / CHUNK))


def last_before(df: DataFrame, keys: list[str], seq: str, value: Column, name: str) -> DataFrame:
    """Adds the last non-null value of the earlier rows of the key."""
    rows = _chunked(df, seq).withColumn("_value", value)
    near = Window.partitionBy(*keys, "_chunk").orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.groupBy(*keys, "_chunk").agg(F.max_by("_value", F.when(F.col("_value").isNotNull(), F.col(seq))).alias("_end"))
    past = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*keys, "_chunk", F.last("_end", True).over(past).alias("_carried"))
    rows = rows.withColumn("_near", F.last("_value", True).over(near))
    joined = rows.join(carried, _same(rows, carried, [*keys, "_chunk"]), "left")
    return joined.select(*[rows[c] for c in df.columns], F.coalesce("_near", "_carried").alias(name))


def next_after(df: DataFrame, keys: list[str], seq: str, value: Column, name: str) -> DataFrame:
    """Adds the first non-null value of the later rows of the key."""
    rows = _chunked(df, seq).withColumn("_value", value)
    near = Window.partitionBy(*keys, "_chunk").orderBy(seq).rowsBetween(1, Window.unboundedFollowing)
    heads = rows.groupBy(*keys, "_chunk").agg(F.min_by("_value", F.when(F.col("_value").isNotNull(), F.col(seq))).alias("_head"))
    future = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(1, Window.unboundedFollowing)
    carried = heads.select(*keys, "_chunk", F.first("_head", True).over(future).alias("_carried"))
    rows = rows.withColumn("_near", F.first("_value", True).over(near))
    joined = rows.join(carried, _same(rows, carried, [*keys, "_chunk"]), "left")
    return joined.select(*[rows[c] for c in df.columns], F.coalesce("_near", "_carried").alias(name))


def values_before(df: DataFrame, keys: list[str], seq: str, value: Column, n: int, name: str) -> DataFrame:
    """Adds the values of up to n rows before each row of the key, in order, where seq numbers its rows from 0 without gaps. The last n
    rows of a chunk are seen by the next one, too, so there is no join."""
    first = F.floor(F.col(seq) / CHUNK)
    seen_by = F.when(F.col(seq) % CHUNK >= CHUNK - n, F.array(first, first + 1)).otherwise(F.array(first))
    rows = df.withColumn("_value", F.struct(value.alias("v"))).withColumn("_chunk", F.explode(seen_by))
    near = Window.partitionBy(*keys, "_chunk").orderBy(seq).rowsBetween(-n, -1)
    rows = rows.withColumn("_before", F.collect_list("_value").over(near)).where(F.col("_chunk") == first)
    return rows.select(*df.columns, F.transform("_before", lambda x: x["v"]).alias(name))


def count_before(df: DataFrame, keys: list[str], seq: str, flag: Column, name: str) -> DataFrame:
    """Adds how many earlier rows of the key have the flag."""
    rows = _chunked(df, seq).withColumn("_flag", F.coalesce(flag, F.lit(False)).cast("long"))
    near = Window.partitionBy(*keys, "_chunk").orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*keys, "_chunk").agg(F.sum("_flag").alias("_sum"))
    past = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select(*keys, "_chunk", F.coalesce(F.sum("_sum").over(past), F.lit(0)).alias("_carried"))
    rows = rows.withColumn("_near", F.coalesce(F.sum("_flag").over(near), F.lit(0)))
    joined = rows.join(carried, _same(rows, carried, [*keys, "_chunk"]), "left")
    return joined.select(*[rows[c] for c in df.columns], (F.col("_near") + F.col("_carried")).alias(name))

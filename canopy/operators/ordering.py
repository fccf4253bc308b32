"""Order-dependent windows that do not put a whole group into one task.

A plain window sorts all rows of its partition key in one task, which one hot group breaks. Here each group
is cut into consecutive buckets of its ordering column. A window runs inside (group, bucket); one small row
per bucket carries what a bucket must know about the earlier ones. The bucket must not decrease along the
order and must hold a bounded number of rows: an integer position divided by a width does both.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WIDTH = 65536
_BUCKET = "_bucket"


def buckets(position: str, width: int = WIDTH) -> Column:
    """Bucket of an integer position that is unique within its group."""
    return F.floor(F.col(position) / width)


def hash_buckets(key: str, rows: int, width: int = WIDTH) -> Column:
    """Bucket of a hexadecimal hash column of a group of up to rows rows: as many leading digits as leave about width
    rows, or fewer, in a bucket."""
    digits = 1
    while 16 ** digits * width < rows:
        digits += 1
    return F.substring(F.col(key), 1, digits)


def _attach(rows: DataFrame, carry: DataFrame, groups: list[str], columns: list[str]) -> DataFrame:
    keys = [*groups, _BUCKET]
    right = carry.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *columns)
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
    return rows.join(right, on, "left").drop(*[f"_k{i}" for i in range(len(keys))])


def _before(groups: list[str]):
    w = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))
    return w.orderBy(_BUCKET).rowsBetween(Window.unboundedPreceding, -1)


def number_rows(df: DataFrame, groups: list[str], order: list, bucket: Column, name: str = "rn") -> DataFrame:
    """row_number() over (partition by groups order by order), for groups of any size."""
    tagged = df.withColumn(_BUCKET, bucket)
    sizes = tagged.groupBy(*groups, _BUCKET).agg(F.count("*").alias("_n"))
    carry = sizes.withColumn("_offset", F.coalesce(F.sum("_n").over(_before(groups)), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy(*groups, _BUCKET).orderBy(*order))
    out = _attach(tagged.withColumn("_inside", inside), carry, groups, ["_offset"])
    return out.withColumn(name, F.col("_offset") + F.col("_inside")).drop("_offset", "_inside", _BUCKET)


def running_sum(df: DataFrame, groups: list[str], order: list, bucket: Column, value: Column, name: str) -> DataFrame:
    """Sum of value from the start of the group to this row."""
    tagged = df.withColumn(_BUCKET, bucket).withColumn("_v", value)
    sums = tagged.groupBy(*groups, _BUCKET).agg(F.sum("_v").alias("_s"))
    carry = sums.withColumn("_offset", F.coalesce(F.sum("_s").over(_before(groups)), F.lit(0)))
    w = Window.partitionBy(*groups, _BUCKET).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = _attach(tagged.withColumn("_run", F.coalesce(F.sum("_v").over(w), F.lit(0))), carry, groups, ["_offset"])
    return out.withColumn(name, F.col("_offset") + F.col("_run")).drop("_offset", "_run", "_v", _BUCKET)


def last_before(df: DataFrame, groups: list[str], order: list, bucket: Column, value: Column, name: str) -> DataFrame:
    """Latest non-null value strictly before this row (an as-of lookup inside the group)."""
    tagged = df.withColumn(_BUCKET, bucket).withColumn("_v", value)
    inner = Window.partitionBy(*groups, _BUCKET).orderBy(*order)
    upto = inner.rowsBetween(Window.unboundedPreceding, -1)
    position = F.struct(*[F.col(o) if isinstance(o, str) else o for o in order])
    lasts = tagged.groupBy(*groups, _BUCKET).agg(
        F.max(F.when(F.col("_v").isNotNull(), F.struct(position.alias("p"), F.col("_v").alias("v")))).alias("_l"))
    carry = lasts.withColumn("_prior", F.last("_l", ignorenulls=True).over(_before(groups)))
    out = _attach(tagged.withColumn("_near", F.last("_v", ignorenulls=True).over(upto)), carry, groups, ["_prior"])
    return out.withColumn(name, F.coalesce("_near", "_prior.v")).drop("_near", "_prior", "_v", _BUCKET)


def top_rows(df: DataFrame, groups: list[str], order: list, n: int, rank: str | None = None) -> DataFrame:
    """First n rows per group. The filter on row_number lets Spark cut each map task to n rows per group
    before the shuffle (WindowGroupLimit), so a hot group ships at most n rows per task."""
    name = rank or "_rank"
    w = Window.partitionBy(*groups).orderBy(*order)
    out = df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= n)
    return out if rank else out.drop(name)


def first_row(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row per key; pre-cut before the shuffle as in top_rows."""
    return top_rows(df, keys, order, 1)


def spread_rows(df: DataFrame, groups: list[str], order: list[str], name: str = "rn") -> DataFrame:
    """row_number() per group for orderings without an integer position: rows are range-partitioned by
    (group, order), kept in the shared folder, and numbered from per-partition counts."""
    from canopy.session import cut

    ranged = cut(df.repartitionByRange(*groups, *order).withColumn("_slice", F.spark_partition_id()))
    return number_rows(ranged, groups, order, F.col("_slice"), name).drop("_slice")

"""As-of joins of keys of any size: a key is cut into time buckets, and each bucket knows the rows next to it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _beside(left: DataFrame, right: DataFrame, keys: list[str], at: str, values: list[str], bucket) -> DataFrame:
    """Left rows with _p, the last right row at or before them, and _n, the first one at or after: structs of _at and the values.

    Within a bucket sorting finds them; for what it does not hold, each bucket's first and last right row are handed on, one
    row a key and bucket. Of right rows at one time the one of greatest values is the last, the one of least the first.
    """
    row = F.struct(F.col(at).alias("_at"), *[F.col(v).alias(v) for v in values])
    cut = F.floor(F.col(at) / bucket)
    kind = right.select(row.alias("r")).schema["r"].dataType
    fill = [F.col(c) if c in keys or c == at else F.lit(None).cast(t).alias(c) for c, t in left.dtypes]
    one = left.withColumn("_b", cut).withColumn("_r", F.lit(None).cast(kind)).withColumn("_side", F.lit(1))
    both = one.unionByName(right.where(F.col(at).isNotNull()).select(*fill, cut.alias("_b"), row.alias("_r"), F.lit(0).alias("_side")))
    own = Window.partitionBy(*keys, "_b")
    so_far = (Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("_p", F.max("_r").over(own.orderBy(F.col(at), "_side").rowsBetween(*so_far)))
    found = found.withColumn("_n", F.min("_r").over(own.orderBy(F.col(at).desc(), "_side").rowsBetween(*so_far))).where("_side = 1")
    by_bucket = Window.partitionBy(*keys).orderBy("_b")
    ends = both.groupBy(*keys, "_b").agg(F.min("_r").alias("_first"), F.max("_r").alias("_last"))
    ends = ends.withColumn("_earlier", F.max("_last").over(by_bucket.rowsBetween(Window.unboundedPreceding, -1))).withColumn("_later", F.min("_first").over(by_bucket.rowsBetween(1, Window.unboundedFollowing)))
    ends = ends.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_b").alias("_e"), "_earlier", "_later")
    same = F.col("_b").eqNullSafe(F.col("_e"))
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    out = found.join(ends, same).withColumn("_p", F.coalesce("_p", "_earlier")).withColumn("_n", F.coalesce("_n", "_later"))
    timed = F.col(at).isNotNull()
    return out.withColumn("_p", F.when(timed, F.col("_p"))).withColumn("_n", F.when(timed, F.col("_n"))).drop("_b", "_e", "_r", "_side", "_earlier", "_later", *[f"_k{i}" for i in range(len(keys))])


def nearest(left: DataFrame, right: DataFrame, keys: list[str], at: str, value: str, bucket, most: float | None = None) -> DataFrame:
    """Each left row with near_at and near_value of its key's nearest right row; a tie takes the earlier, beyond ``most`` both are null.

    ``bucket``, in units of ``at``, says how far a task's share of a key reaches; results do not depend on it.
    """
    both = _beside(left, right, keys, at, [value], bucket)
    earlier = F.col("_n").isNull() | (F.col(at) - F.col("_p._at") <= F.col("_n._at") - F.col(at))
    out = both.withColumn("_m", F.when(earlier, F.col("_p")).otherwise(F.col("_n")))
    ok = F.lit(True) if most is None else F.abs(F.col("_m._at") - F.col(at)) <= most
    return out.withColumn("near_at", F.when(ok, F.col("_m._at"))).withColumn("near_value", F.when(ok, F.col("_m")[value])).drop("_p", "_n", "_m")


def backward(left: DataFrame, right: DataFrame, keys: list[str], at: str, values: list[str], bucket) -> DataFrame:
    """Each left row with the values of the last right row at or before it, else of its key's first."""
    m = F.coalesce("_p", "_n")
    return _beside(left, right, keys, at, values, bucket).select(*left.columns, *[m[v].alias(v) for v in values])


def on_grid(frames: DataFrame, keys: list[str], at: str, value: str, step, tolerance) -> DataFrame:
    """Fixed-rate rows from each key's first to last frame, a thousand of them a bucket: the nearest frame, or is_missing."""
    ends = frames.groupBy(*keys).agg(F.min(at).alias("_a"), F.max(at).alias("_z"))
    blocks = ends.withColumn("_k", F.explode(F.sequence(F.lit(0), F.floor((F.col("_z") - F.col("_a")) / step / 1000))))
    last = F.least(F.floor((F.col("_z") - F.col("_a")) / step), F.col("_k") * 1000 + 999)
    points = blocks.select(*keys, "_a", F.explode(F.sequence(F.col("_k") * 1000, last)).alias("_i")).select(*keys, (F.col("_a") + F.col("_i") * step).cast(dict(frames.dtypes)[at]).alias(at))
    return nearest(points, frames.select(*keys, at, value), keys, at, value, 1000 * step, tolerance).withColumn("is_missing", F.col("near_at").isNull().cast("int"))

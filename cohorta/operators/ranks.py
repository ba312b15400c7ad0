"""Order over a whole table or a large key without sorting it in one task.

Values are dealt to ranges by split points that are worked out once from a sketch of all values, so a
row's range depends on its value alone. A range is sorted by itself; what stands before it is the sum
of the smaller ranges' sizes, of which a key has as many as there are split points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohorta.operators.group import correlation

#: Ranges that values are dealt to; each is a task's share of a key that holds all rows.
RANGES = 256


def split_points(df: DataFrame, c: str, ranges: int = RANGES) -> list[float]:
    """At most ``ranges`` - 1 rising values that cut a numeric column into parts of about equal size."""
    at = [i / ranges for i in range(1, ranges)]
    found = df.agg(F.percentile_approx(F.col(c).cast("double"), at, F.lit(20 * ranges)).alias("p")).first()["p"] or []
    return sorted({x for x in found if x is not None and x == x})


def range_of(c: Column, points: list[float]) -> Column:
    """The number of split points at or below a value, by halving; null for null."""

    def search(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(c >= F.lit(points[mid]), search(mid + 1, high)).otherwise(search(low, mid))

    return F.when(c.isNotNull(), search(0, len(points)))


def running(counts: DataFrame, keys: list[str], c: str, n: str, points: list[float]) -> DataFrame:
    """Adds _before (what ``n`` adds up to over a key's smaller values) and _total (over all of them); one row a key and value."""
    dealt = counts.withColumn("_g", range_of(F.col(c), points))
    sizes = dealt.groupBy(*keys, "_g").agg(F.sum(n).alias("_s"))
    w = Window.partitionBy(*keys)  # one row a range
    sizes = sizes.withColumn("_total", F.sum("_s").over(w)).withColumn("_offset", F.sum("_s").over(w.orderBy("_g")) - F.col("_s")).drop("_s")
    local = F.sum(n).over(Window.partitionBy(*keys, "_g").orderBy(c)) - F.col(n)
    return _same(dealt.withColumn("_local", local), sizes, [*keys, "_g"]).withColumn("_before", F.col("_offset") + F.col("_local")).drop("_g", "_local", "_offset")


def _same(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join in which null keys are equal."""
    r = right.select(*[F.col(k).alias(f"_same_{k}") if k in keys else F.col(k) for k in right.columns])
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_same_{k}"))
    return left.join(r, on, how).drop(*[f"_same_{k}" for k in keys])


def value_counts(df: DataFrame, keys: list[str], c: str) -> DataFrame:
    return df.where(F.col(c).isNotNull()).groupBy(*keys, c).agg(F.count("*").alias("_m"))


def ranked(df: DataFrame, keys: list[str], c: str, name: str, points: list[float] | None = None) -> DataFrame:
    """Adds the rank of a value in its key; equal values share the mean of their ranks, null has none."""
    points = split_points(df, c) if points is None else points
    r = running(value_counts(df, keys, c), keys, c, "_m", points)
    r = r.select(*keys, c, (F.col("_before") + (F.col("_m") + 1) / 2).alias(name))
    return _same(df, r, [*keys, c], "left")


def percentiles(df: DataFrame, keys: list[str], c: str, shares: dict[str, float], points: list[float] | None = None) -> DataFrame:
    """keys, n and the exact percentiles by name, between two values by their distance, of keys with any value."""
    points = split_points(df, c) if points is None else points
    r = running(value_counts(df, keys, c), keys, c, "_m", points)
    out = [F.max("_total").alias("n")]
    for name, share in shares.items():
        at = (F.col("_total") - 1) * F.lit(float(share))
        of = lambda k: F.max(F.when((F.col("_before") <= k) & (k < F.col("_before") + F.col("_m")), F.col(c).cast("double")))
        low, high, part = of(F.floor(at)), of(F.ceil(at)), F.max(at - F.floor(at))
        out.append((low + (high - low) * part).alias(name))
    return r.groupBy(*keys).agg(*out)


def correlations(df: DataFrame, features: list[str], least: int = 5) -> DataFrame:
    """a, b, n, Pearson and Spearman of every pair of features over the rows that have both.

    Where no value is missing each feature is ranked once for all pairs; else a pair ranks its own complete rows.
    """
    names = sorted(features)
    cast = df.select(*[F.col(c).cast("double").alias(c) for c in names])
    filled = cast.agg(*[F.count("*").alias("_n"), *[F.count(c).alias(c) for c in names]]).first()
    whole = [c for c in names if filled[c] == filled["_n"]]
    points = {c: split_points(cast, c) for c in names}
    table = cast
    for c in whole:
        table = ranked(table, [], c, f"_r_{c}", points[c])
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    at_once = [(a, b) for a, b in pairs if a in whole and b in whole]
    out = None
    if at_once:
        figures = table.agg(F.count("*").alias("n"), *[correlation(F.col(a), F.col(b)).alias(f"p{i}") for i, (a, b) in enumerate(at_once)], *[correlation(F.col(f"_r_{a}"), F.col(f"_r_{b}")).alias(f"s{i}") for i, (a, b) in enumerate(at_once)])
        rows = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col("n"), F.col(f"p{i}").alias("pearson"), F.col(f"s{i}").alias("spearman")) for i, (a, b) in enumerate(at_once)])
        out = figures.select(F.explode(rows).alias("r")).select("r.*")
    for a, b in pairs:
        if (a, b) not in at_once:
            both = cast.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("x"), F.col(b).alias("y"))
            r = ranked(ranked(both, [], "x", "_rx", points[a]), [], "y", "_ry", points[b])
            one = r.agg(F.count("*").alias("n"), correlation(F.col("x"), F.col("y")).alias("pearson"), correlation(F.col("_rx"), F.col("_ry")).alias("spearman")).select(F.lit(a).alias("a"), F.lit(b).alias("b"), "n", "pearson", "spearman")
            out = one if out is None else out.unionAll(one)
    return out.where(F.col("n") >= least)


def tertiles(df: DataFrame, keys: list[str], c: str) -> DataFrame:
    """t1, t2: half way from the value at place n // 3 (2n // 3) to the next lower one, with the rules of ``evaluate.tertile_thresholds``.

    The next lower value of a range's first is the largest of the ranges below.
    """
    points = split_points(df, c)
    counts = running(value_counts(df, keys, c), keys, c, "_m", points).withColumn("_g", range_of(F.col(c), points))
    tops = counts.groupBy(*keys, "_g").agg(F.max(c).alias("_top"))
    below = F.max("_top").over(Window.partitionBy(*keys).orderBy("_g").rowsBetween(Window.unboundedPreceding, -1))
    counts = _same(counts, tops.withColumn("_under", below).drop("_top"), [*keys, "_g"])
    lower = F.coalesce(F.lag(c).over(Window.partitionBy(*keys, "_g").orderBy(c)), F.col("_under"))
    counts = counts.withColumn("_mid", F.coalesce((F.col(c) + lower) / 2, F.col(c) - 0.5))
    holds = lambda share: (F.floor(share * F.col("_total") / 3) >= F.col("_before")) & (F.floor(share * F.col("_total") / 3) < F.col("_before") + F.col("_m"))
    t = counts.groupBy(*keys).agg(F.max(F.when(holds(1), F.col("_mid"))).alias("t1"), F.max(F.when(holds(2), F.col("_mid"))).alias("_t"))
    above = _same(counts, t, keys).where(F.col(c) > F.col("t1") + 0.5).groupBy(*keys).agg(F.min(c).alias("_above"))
    return _same(t, above, keys, "left").select(*keys, "t1", F.when(F.col("_t") > F.col("t1"), F.col("_t")).otherwise(F.coalesce((F.col("t1") + F.col("_above")) / 2, F.col("t1") + 1)).alias("t2"))


def row_numbers(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Adds a row's number, from 1, in the whole table's order by columns of which the first is a number; ties in all go any way."""
    points = split_points(df, order[0])
    dealt = df.withColumn("_range", F.coalesce(range_of(F.col(order[0]), points), F.lit(-1)))
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("_size"))
    sizes = sizes.withColumn("_above", F.sum("_size").over(Window.orderBy("_range")) - F.col("_size")).drop("_size")  # one row a range
    local = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return dealt.withColumn("_local", local).join(F.broadcast(sizes), "_range").withColumn(name, F.col("_above") + F.col("_local")).drop("_range", "_local", "_above")

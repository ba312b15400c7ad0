"""Group dynamics and table-level statistics: synchrony, deltas, correlations, coverage, roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Z95 = 1.96


def group_window(df: DataFrame, keys: list[str], member: str, metrics: list[str]) -> DataFrame:
    """Members, and each metric's mean and population sd."""
    return df.groupBy(*keys).agg(F.countDistinct(member).alias("members"), *[f(m).alias(f"{m}_{n}") for m in metrics for n, f in (("mean", F.avg), ("sd", F.stddev_pop))])


def speech_dynamics(df: DataFrame, keys: list[str], member: str, amount: str, least: float = 0.01) -> DataFrame:
    """Per member and bucket: share of the total; per bucket: active members, sd, entropy of shares."""
    w = Window.partitionBy(*keys)
    total = F.sum(amount).over(w)
    share = F.when(total >= least, F.col(amount) / total).otherwise(0.0)
    s = df.withColumn("total", total).withColumn("share", share)
    return s.withColumn("active", F.sum((F.col(amount) > 0).cast("int")).over(w)).withColumn("spread", F.coalesce(F.stddev_samp(amount).over(w), F.lit(0.0))).withColumn("entropy", F.coalesce(-F.sum(F.when(F.col("share") > 0, F.col("share") * F.ln("share"))).over(w), F.lit(0.0)))


def correlation(a: Column, b: Column) -> Column:
    """An aggregate over complete pairs; null without spread (the built-in one fails there in ANSI mode)."""
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def pearson(x: str, y: str, least: int = 3) -> Column:
    """Correlation over complete pairs, of ``least`` or more and with some spread in both; an aggregate."""
    ok = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(ok, F.col(x)), F.when(ok, F.col(y))
    return F.when(F.count(a) >= least, correlation(a, b))


def best_lag(pairs: DataFrame, keys: list[str], order: str, x: str, y: str, most: int = 2, least: int = 3) -> DataFrame:
    """The lag in rows, -most .. most, of largest (signed) correlation of x with y that many rows on.

    Rows where both are missing do not count as rows. The earliest lag wins a tie.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    rows = pairs.where(F.col(x).isNotNull() | F.col(y).isNotNull()).withColumn("_r", F.row_number().over(w))
    left = rows.select(*keys, F.col(x).alias("_x"), F.explode(F.sequence(F.lit(-most), F.lit(most))).alias("lag"), "_r").withColumn("_r", F.col("_r") + F.col("lag"))
    both = left.join(rows.select(*keys, "_r", F.col(y).alias("_y")), [*keys, "_r"])
    each = both.groupBy(*keys, "lag").agg(pearson("_x", "_y", least).alias("r")).where("r is not null")
    return each.groupBy(*keys).agg(F.max(F.struct("r", (-F.col("lag")).alias("_l"))).alias("_b")).select(*keys, (-F.col("_b._l")).alias("lag"), F.col("_b.r").alias("r"))


def unpivot(df: DataFrame, keys: list[str], values: list[str], name: str = "feature", value: str = "value") -> DataFrame:
    return df.unpivot(keys, [F.col(v).cast("double").alias(v) for v in values], name, value)


def series(df: DataFrame, keys: list[str], c: str) -> DataFrame:
    """n, mean, median, sample sd, standard error, 95 % interval, quartiles, mean / sd."""
    x = F.col(c)
    a = df.where(x.isNotNull()).groupBy(*keys).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.percentile(x, F.lit(0.5)).alias("median"), F.stddev_samp(x).alias("sd"), F.percentile(x, F.lit(0.25)).alias("p25"), F.percentile(x, F.lit(0.75)).alias("p75"))
    a = a.withColumn("sem", F.col("sd") / F.sqrt("n"))
    return a.withColumn("low", F.col("mean") - Z95 * F.col("sem")).withColumn("high", F.col("mean") + Z95 * F.col("sem")).withColumn("effect", F.when(F.col("sd") > 0, F.col("mean") / F.col("sd")))


def average_ranks(df: DataFrame, c: str, keys: list[str], name: str) -> DataFrame:
    """Adds the rank of a value in its group; equal values share the mean of their ranks, null has none.

    Values are counted first, so only a group's distinct values are sorted together.
    """
    w = Window.partitionBy(*keys).orderBy(c)
    n = df.where(F.col(c).isNotNull()).groupBy(*keys, c).agg(F.count("*").alias("_m"))
    r = n.withColumn(name, F.sum("_m").over(w) - (F.col("_m") - 1) / 2).drop("_m")
    return df.join(r, [*keys, c], "left")


def pair_correlations(df: DataFrame, row: list[str], features: list[str], least: int = 5) -> DataFrame:
    """Pearson and Spearman of every unordered pair of features over complete rows.

    Pairs are formed from the columns, not by joining rows, so each row is read once.
    """
    pairs = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y")) for i, a in enumerate(sorted(features)) for b in sorted(features)[i + 1 :]]
    each = df.select(F.explode(F.array(*pairs)).alias("p")).select("p.*").where("x is not null and y is not null")
    ranked = average_ranks(average_ranks(each, "x", ["a", "b"], "rx"), "y", ["a", "b"], "ry")
    return ranked.groupBy("a", "b").agg(F.count("*").alias("n"), pearson("x", "y", least).alias("pearson"), pearson("rx", "ry", least).alias("spearman")).where(F.col("n") >= least)


def partial_correlation(df: DataFrame, keys: list[str], x: str, y: str, z: str, least: int = 8) -> DataFrame:
    """Correlation of x and y after a straight-line fit of each on z has been taken off."""
    ok = df.where(F.col(x).isNotNull() & F.col(y).isNotNull() & F.col(z).isNotNull())
    a = ok.groupBy(*keys).agg(F.count("*").alias("n"), correlation(F.col(x), F.col(y)).alias("_xy"), correlation(F.col(x), F.col(z)).alias("_xz"), correlation(F.col(y), F.col(z)).alias("_yz"))
    rest = F.sqrt((1 - F.col("_xz") ** 2) * (1 - F.col("_yz") ** 2))
    return a.where(F.col("n") >= least).select(*keys, "n", F.when(rest > 1e-12, (F.col("_xy") - F.col("_xz") * F.col("_yz")) / rest).alias("r"))


def usability(df: DataFrame, features: list[str], expected: int) -> DataFrame:
    """Per feature: usable values, share of the rows there are, share of the rows expected."""
    u = unpivot(df, [], features)
    return u.groupBy("feature").agg(F.count("value").alias("usable"), (100.0 * F.count("value") / F.count("*")).alias("of_observed"), (100.0 * F.count("value") / F.lit(expected)).alias("of_expected"))


def coverage(expected: DataFrame, keys: list[str], by: list[str], sides: dict[str, DataFrame]) -> DataFrame:
    """Per ``by``: expected rows, rows that each side has, that all have, and percentages.

    sides: distinct keys by name.
    """
    out = expected
    for n, d in sides.items():
        out = out.join(d.select(*keys).distinct().withColumn(n, F.lit(1)), keys, "left")
    every = sum((F.coalesce(F.col(n), F.lit(0)) for n in sides), F.lit(0)) == len(sides)
    aggs = [F.count("*").alias("expected"), *[F.count(n).alias(n) for n in sides], F.sum(every.cast("int")).alias("all_sides")]
    a = out.groupBy(*by).agg(*aggs)
    for n in [*sides, "all_sides"]:
        a = a.withColumn(f"{n}_pct", 100.0 * F.col(n) / F.col("expected"))
    return a


def flag_counts(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """How often each flag of a ``;``-joined list occurs, and in what share of the key's rows."""
    n = df.groupBy(*keys).agg(F.count("*").alias("rows"))
    each = df.select(*keys, F.explode(F.array_distinct(F.split(F.col(text), ";"))).alias("flag")).where("flag != ''")
    c = each.groupBy(*keys, "flag").agg(F.count("*").alias("n"))
    c = c.join(n, keys) if keys else c.crossJoin(n)  # one row of totals
    return c.withColumn("pct", 100.0 * F.col("n") / F.col("rows"))


def pooled(df: DataFrame, keys: list[str], member: str | None = None) -> DataFrame:
    """Every numeric column's mean and population sd by key, whatever the columns are."""
    numeric = [c for c, t in df.dtypes if c not in keys and c != member and t in ("double", "float", "int", "bigint", "smallint", "tinyint")]
    return df.groupBy(*keys).agg(F.count("*").alias("rows"), *[f(c).alias(f"{c}_{n}") for c in numeric for n, f in (("mean", F.avg), ("sd", F.stddev_pop))])


def against_group(df: DataFrame, keys: list[str], c: str) -> DataFrame:
    """Adds delta to the group's mean and z by its population sd (null without spread)."""
    w = Window.partitionBy(*keys)
    d = F.col(c) - F.avg(c).over(w)
    return df.withColumn("delta", d).withColumn("z", F.when(F.stddev_pop(c).over(w) > 0, d / F.stddev_pop(c).over(w)))


def agreement(df: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Share of rows with equal labels among those where both are there and not empty."""
    ok = (F.coalesce(F.col(a), F.lit("")) != "") & (F.coalesce(F.col(b), F.lit("")) != "")
    return df.groupBy(*keys).agg(F.sum(ok.cast("int")).alias("n"), F.avg(F.when(ok, (F.col(a) == F.col(b)).cast("double"))).alias("agreement"))


def answers_wide(df: DataFrame, keys: list[str], item: str, text: str, items: list[str]) -> DataFrame:
    """Per key: each item's mean as a number and its distinct answers in order; and how many answers."""
    number = F.col(text).try_cast("double")
    aggs = [F.count("*").alias("answers")]
    for i in items:
        mine = F.when(F.col(item) == i, F.col(text))
        aggs += [F.avg(F.when(F.col(item) == i, number)).alias(f"{i}_mean"), F.array_join(F.array_sort(F.collect_set(mine)), "|").alias(f"{i}_text")]
    return df.groupBy(*keys).agg(*aggs)


def first_values(df: DataFrame, keys: list[str], item: str, value: str, order: str, items: list[str], needed: list[str]) -> DataFrame:
    """Per key the first value of each item; rows without one of the needed items go."""
    out = df.groupBy(*keys).agg(*[F.min_by(F.when(F.col(item) == i, F.col(value)), F.when((F.col(item) == i) & F.col(value).isNotNull(), F.col(order))).alias(i) for i in items])
    return out.dropna("any", subset=needed)


def item_means(df: DataFrame, keys: list[str], item: str, value: str, items: list[str]) -> DataFrame:
    return df.groupBy(*keys).pivot(item, items).agg(F.avg(value))


def trait_scores(answers: DataFrame, person: str, item: str, score: str, key: DataFrame) -> DataFrame:
    """Mean, to 3 decimals, of the scored items of each domain (key: item, domain)."""
    return answers.join(key, item).where(F.col(score).isNotNull()).groupBy(person, "domain").agg(F.round(F.avg(score), 3).alias("score"))


def rolled_up(df: DataFrame, sets: list[list[str]], aggs: list[Column]) -> DataFrame:
    """The same aggregates by several key sets at once (grouping sets)."""
    cols = list(dict.fromkeys(c for s in sets for c in s))
    return df.groupingSets([[F.col(c) for c in s] for s in sets], *cols).agg(*aggs)


def key_findings(parts: dict[str, tuple[DataFrame, str, str, int]]) -> DataFrame:
    """The largest rows, by absolute value, of several tables: finding, name, value."""
    out = None
    for kind, (df, name, value, k) in parts.items():
        top = df.where(F.col(value).isNotNull()).orderBy(F.abs(F.col(value)).desc(), name).limit(k).select(F.lit(kind).alias("finding"), F.col(name).cast("string").alias("name"), F.col(value).cast("double").alias("value"))
        out = top if out is None else out.unionByName(top)
    return out


def task_shift(df: DataFrame, task: str, c: str) -> DataFrame:
    """Task mean less the mean over all rows."""
    whole = df.agg(F.avg(c).alias("_m"))
    return df.groupBy(task).agg(F.avg(c).alias("mean")).crossJoin(F.broadcast(whole)).select(task, (F.col("mean") - F.col("_m")).alias("shift"))


def shared_attention(samples: DataFrame, us: str, member: str, zone: str, bin_us: int) -> DataFrame:
    """Per time bin and zone: the sum over members of the share of their samples in that zone."""
    b = samples.withColumn("bin", F.floor(F.col(us) / bin_us))
    n = b.groupBy("bin", member, zone).agg(F.count("*").alias("_n"))
    share = F.col("_n") / F.sum("_n").over(Window.partitionBy("bin", member))
    return n.withColumn("_s", share).groupBy("bin", zone).agg(F.sum("_s").alias("attention"))

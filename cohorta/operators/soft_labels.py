"""Soft labels of unlabelled windows from everybody's reports and bodily evidence of the others.

Reports and evidence are one table of observations, each with its own noise; a window's label is the posterior of a
mean-reverting process at its time. Observations further away than ``REACH`` time constants weigh less than a double can
show, so a window meets those of its own time block and what reaches into it, never a whole session.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohorta.functions.scalars import soft_label
from cohorta.operators import asof, ranks
from cohorta.operators.group import correlation
from cohorta.operators.joins import band_join

REACH = 40.0
#: Noise of one's own report, of another's at agreement 1, of a strong and a weak response and of a rate's direction.
OWN, OTHER, STRONG, WEAK, DIRECTION = 0.8, 1.2, 0.8, 1.4, 1.8
STRONG_FROM, MOST_WEIGHT, OTHERS_SHARE = 0.2, 0.95, 0.6
LEAST_AGREEMENT, MOST_AGREEMENT = 0.05, 0.95
NO_SPREAD = 1e-9


@dataclass(frozen=True)
class Dimension:
    """A rated dimension: its process (long-run mean, rate, variance), the least weight, and what evidence it takes ("response", "direction" or "")."""

    name: str
    mean: float
    rate: float
    variance: float
    least_weight: float = 0.1
    evidence: str = ""


def by_name(values: dict[str, float], key: Column, otherwise=None) -> Column:
    out = F.lit(otherwise).cast("double")
    for k, v in values.items():
        out = F.when(key == k, F.lit(float(v))).otherwise(out)
    return out


def agreement(reports: DataFrame, keys: list[str], seat: str, at: str, dims: list[str], width, prior: Column, least: int = 3) -> DataFrame:
    """keys, seat, other, dim, rho: how far two seats' reports of one key go together, the same in both directions.

    Each report of the smaller seat meets the other seat's first report less than ``width`` away. Of ``least`` such pairs their
    correlation counts, up to 0.95; if it is not above 0 or not defined, as with a missing value in any pair or no spread of one side
    (``NO_SPREAD``; partial sums of equal values leave one in the last digits), 0.05. With fewer
    pairs ``prior`` (of the columns of keys and ``dim``) does. Reports are one a seat and time.
    """
    seats = reports.select(*keys, seat).distinct()
    pairs = seats.join(seats.withColumnRenamed(seat, "other"), keys).where(F.col(seat) < F.col("other"))
    near = band_join(reports, reports, keys, at, width, seat).where((F.col(seat) < F.col(f"r_{seat}")) & (F.abs(F.col(at) - F.col(f"r_{at}")) < width))
    first = near.groupBy(*keys, seat, at, F.col(f"r_{seat}").alias("other")).agg(F.min_by(F.struct(*dims, *[f"r_{d}" for d in dims]), F.col(f"r_{at}")).alias("p"))
    each = first.select(*keys, seat, "other", F.explode(F.array(*[F.struct(F.lit(d).alias("dim"), F.col(f"p.{d}").cast("double").alias("x"), F.col(f"p.r_{d}").cast("double").alias("y")) for d in dims])).alias("e"))
    spread = (F.stddev_pop("e.x") > NO_SPREAD) & (F.stddev_pop("e.y") > NO_SPREAD)
    found = each.groupBy(*keys, seat, "other", "e.dim").agg(F.count("*").alias("_n"), F.count(F.col("e.x") + F.col("e.y")).alias("_m"), F.when(spread, correlation(F.col("e.x"), F.col("e.y"))).alias("_c"))
    every = pairs.withColumn("dim", F.explode(F.array(*[F.lit(d) for d in dims]))).join(found, [*keys, seat, "other", "dim"], "left")
    measured = F.when((F.col("_m") == F.col("_n")) & F.coalesce(F.col("_c") > 0, F.lit(False)), F.least("_c", F.lit(MOST_AGREEMENT))).otherwise(LEAST_AGREEMENT)
    rho = F.when(F.coalesce("_n", F.lit(0)) >= least, measured).otherwise(prior)
    one = every.select(*keys, seat, "other", "dim", rho.alias("rho"))
    return one.unionByName(one.select(*keys, F.col("other").alias(seat), F.col(seat).alias("other"), "dim", "rho"))


def nearby_evidence(points: DataFrame, windows: DataFrame, events: DataFrame, keys: list[str], seat: str, window: str, at: str, value: str, width, first: int = 3) -> DataFrame:
    """keys, seat, the point's time, other, ``at``, value, m: events of each other seat's windows at most ``width`` away, else of its ``first`` ones.

    points: keys, seat and time, each once; events: keys, seat, window, ``at``, value. ``m`` is how many events are the same.
    """
    timed = windows.select(*keys, seat, window, F.col(at).alias("_t"))
    of = events.select(*keys, seat, window, F.col("at").alias("_at"), F.col(value).alias("_value"))
    same = lambda df, *by: df.groupBy(*keys, *by, "_at", "_value").agg(F.count("*").alias("m"))
    met = same(of.join(timed, [*keys, seat, window]), seat, "_t").withColumnRenamed("_t", at)
    out = [*keys, seat, at, "other", "_at", "_value", "m"]
    near = band_join(points, met, keys, at, width, seat).select(*keys, seat, at, F.col(f"r_{seat}").alias("other"), F.col("r__at").alias("_at"), F.col("r__value").alias("_value"), F.col("r_m").alias("m"))
    head = timed.withColumn("_n", F.row_number().over(Window.partitionBy(*keys, seat).orderBy("_t", window))).where(F.col("_n") <= first)
    head = same(head.join(of, [*keys, seat, window]), seat).withColumnRenamed(seat, "other")
    seen = band_join(points, points, keys, at, width, seat).select(*keys, seat, at, F.col(f"r_{seat}").alias("other")).distinct()
    others = points.select(*keys, F.col(seat).alias("other")).distinct()
    none = points.join(others, keys).where(F.col(seat) != F.col("other")).join(seen, [*keys, seat, at, "other"], "left_anti")
    return near.select(*out).unionByName(none.join(head, [*keys, "other"]).select(*out))


#: Cells of a table of points by observations that is worked on at once.
CELLS = 2_000_000


def _one_side(points: int, of: np.ndarray, gap: np.ndarray, y: np.ndarray, s: np.ndarray, rate: float, var: float) -> tuple[np.ndarray, np.ndarray]:
    """Mean and variance at each point, given the observations ``gap`` away from it on one side; ``of`` is an observation's point."""
    x, v = np.zeros(points), np.full(points, var)
    if not len(of):
        return x, v
    order = np.lexsort((-gap, of))
    of, gap, y, s = of[order], gap[order], y[order], s[order]
    n = np.bincount(of, minlength=points)
    k, start = int(n.max()), np.cumsum(n) - n
    col = k - n[of] + np.arange(len(of)) - start[of]
    away = np.repeat(np.where(n > 0, gap[np.minimum(start, len(gap) - 1)], 0.0)[:, None], k, axis=1)
    seen, noise = np.zeros((points, k)), np.full((points, k), np.inf)
    away[of, col], seen[of, col], noise[of, col] = gap, y, s * s
    for i in range(k):
        if i:
            keep = np.exp(-rate * (away[:, i - 1] - away[:, i]))
            x, v = keep * x, keep * keep * v + (1 - keep * keep) * var
        gain = v / (v + noise[:, i])
        x, v = x + gain * (seen[:, i] - x), (1 - gain) * v
    keep = np.exp(-rate * away[:, -1])
    return keep * x, keep * keep * v + (1 - keep * keep) * var


def _at_points(t: np.ndarray, of: np.ndarray, at: np.ndarray, y: np.ndarray, s: np.ndarray, rate: float, var: float) -> tuple[np.ndarray, np.ndarray]:
    """Mean (about the long-run one) and sd at each time: what goes before it and what comes after it meet there, as the process is Markov."""
    before = at <= t[of]
    gap = np.abs(t[of] - at)
    side = lambda these: _one_side(len(t), of[these], gap[these], y[these], s[these], rate, var)
    (xa, va), (xb, vb) = side(before), side(~before)
    va, vb = np.maximum(va, 1e-15), np.maximum(vb, 1e-15)
    p = 1 / va + 1 / vb - 1 / var
    return (xa / va + xb / vb) / p, np.sqrt(np.maximum(1 / p, 1e-12))


def posteriors(points: DataFrame, shared: DataFrame, single: DataFrame, keys: list[str], at: str, dims: list[Dimension]) -> DataFrame:
    """keys, time, dim, mu, sigma and alone (the sd by one's own reports only) of each point (keys, time, dim) of ``points``.

    shared: observations (keys, dim, time, y, noise, _own) of all points of a key; single: those (keys, time, dim, _at, y, noise) of
    a single one. A block of time of the first key's points is worked on together, all of them side by side.
    """
    process = {d.name: (d.mean, d.rate, d.variance) for d in dims}
    reach = by_name({d.name: REACH / d.rate for d in dims}, F.col("dim"))
    block = lambda t: F.floor(t / (2 * reach))
    by, rest = [keys[0], "dim", "_block"], keys[1:]
    q = points.select(*keys, "dim", block(F.col(at)).alias("_block"), F.col(at).alias("_t"))
    real = lambda c: F.col(c).cast("double")
    o = shared.withColumn("_block", F.explode(F.sequence(block(F.col(at) - reach), block(F.col(at) + reach)))).select(*keys, "dim", "_block", F.lit(None).cast("double").alias("_q"), real(at).alias("_at"), real("y").alias("y"), real("noise").alias("noise"), "_own")
    o = o.unionByName(single.select(*keys, "dim", block(F.col(at)).alias("_block"), real(at).alias("_q"), real("_at").alias("_at"), real("y").alias("y"), real("noise").alias("noise"), F.lit(0).alias("_own")))
    o = o.select(*[F.col(c).alias(f"_o_{c}") for c in (*by, *rest)], "_q", "_at", "y", "noise", "_own")
    kinds = dict(points.dtypes)

    def run(q: pa.Table, o: pa.Table) -> pa.Table:
        n = q.num_rows
        mu, sigma, alone = np.empty(n), np.empty(n), np.empty(n)
        if n:
            mean, rate, var = process[q.column("dim")[0].as_py()]
            t = q.column("_t").to_numpy().astype(float)
            oq, oat, oy, os_, own = (o.column(c).to_numpy().astype(float) for c in ("_q", "_at", "y", "noise", "_own"))
            key = np.zeros(n + o.num_rows, np.int64)
            for c in rest:
                codes = pa.chunked_array([*q.column(c).chunks, *o.column(f"_o_{c}").chunks], q.schema.field(c).type).combine_chunks().dictionary_encode("encode").indices.to_numpy()
                key = np.unique(key * (codes.max() + 1) + codes, return_inverse=True)[1]
            mine, theirs = key[:n], key[n:]
            # Shared observations sorted by key; single ones by the point that they belong to.
            all_ = np.flatnonzero(np.isnan(oq))
            all_ = all_[np.argsort(theirs[all_], kind="stable")]
            held = np.bincount(theirs[all_], minlength=int(key.max()) + 1)
            first = np.cumsum(held) - held
            times = np.unique(t)
            place = mine * len(times) + np.searchsorted(times, t)
            sorted_ = np.argsort(place)
            one = np.flatnonzero(~np.isnan(oq))
            point = sorted_[np.searchsorted(place[sorted_], theirs[one] * len(times) + np.searchsorted(times, oq[one]))]
            one, point = one[np.argsort(point, kind="stable")], np.sort(point)
            ones = np.bincount(point, minlength=n)
            from_ = np.cumsum(ones) - ones
            size = held[mine] + ones
            order, start = np.argsort(size, kind="stable"), 0
            spread = lambda start, n: np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())
            while start < n:
                stop = start + 1
                while stop < n and (stop + 1 - start) * (size[order[stop]] + 1) <= CELLS:
                    stop += 1
                at_ = order[start:stop]
                h, m = held[mine[at_]], ones[at_]
                obs = all_[spread(first[mine[at_]], h)]
                of = np.repeat(np.arange(len(at_)), h)
                by_self = own[obs] == 1
                alone[at_] = _at_points(t[at_], of[by_self], oat[obs[by_self]], oy[obs[by_self]] - mean, os_[obs[by_self]], rate, var)[1]
                obs, of = np.concatenate((obs, one[spread(from_[at_], m)])), np.concatenate((of, np.repeat(np.arange(len(at_)), m)))
                mu[at_], sigma[at_] = _at_points(t[at_], of, oat[obs], oy[obs] - mean, os_[obs], rate, var)
                start = stop
            mu += mean
        return pa.table([*(q.column(k) for k in keys), q.column("_t"), q.column("dim"), pa.array(mu), pa.array(sigma), pa.array(alone)], names=[*keys, at, "dim", "mu", "sigma", "alone"])

    schema = ", ".join(f"{k} {kinds[k]}" for k in (*keys, at)) + ", dim string, mu double, sigma double, alone double"
    return q.groupBy(*by).cogroup(o.groupBy(*[f"_o_{c}" for c in by])).applyInArrow(run, schema)


def soft_labels(windows: DataFrame, reports: DataFrame, responses: DataFrame, directions: DataFrame, dims: list[Dimension], prior: Column, *, width=90.0, near=45.0, cuts: tuple[float, float] = (3.0, 6.0), absent: dict[str, list[str]] | None = None) -> DataFrame:
    """One row a window and dimension: mu, sigma, soft (three classes), weight, n_own, n_other, n_evidence.

    windows: session, task, seat, window, t; reports: session, task, seat, t and a column for each dimension; responses:
    session, task, seat, window, at, amplitude; directions: the same with shift instead. ``prior`` is the agreement of seats that
    reports do not tell, of the columns task and dim. ``absent`` names the dimensions that a task does not ask for: no mu and sigma
    there, thirds as label, weight 0. Windows without time go. All times are in one unit, that of the processes' rates.
    """
    place, key = ["session", "task"], ["session", "task", "seat"]
    names = [d.name for d in dims]
    each = lambda df: df.withColumn("dim", F.explode(F.array(*[F.lit(d) for d in names])))
    gone = F.lit(False)
    for task, missing in (absent or {}).items():
        gone = gone | ((F.col("task") == task) & F.col("dim").isin(missing))
    timed = windows.where(F.col("t").isNotNull())
    # Windows of one seat at one time have one label; it is worked out once.
    points = timed.select(*key, "t").distinct()
    live = each(points).where(~gone)
    seats = windows.select(*key).distinct()
    reporting = reports.select(*place, F.col("seat").alias("other")).distinct()
    rho = each(seats.join(reporting, place).where(F.col("seat") != F.col("other")))
    found = agreement(reports, place, "seat", "t", names, width, prior)
    rho = rho.join(found, [*key, "other", "dim"], "left").withColumn("rho", F.coalesce("rho", prior)).localCheckpoint()
    long = reports.select(*key, "t", F.explode(F.array(*[F.struct(F.lit(d).alias("dim"), F.col(d).cast("double").alias("y")) for d in names])).alias("e")).select(*key, "t", "e.dim", "e.y").where("y is not null and not isnan(y)")
    cross = long.withColumnRenamed("seat", "other").join(rho, [*place, "other", "dim"])
    clip = lambda c, low, high: F.least(F.greatest(c, F.lit(low)), F.lit(high))
    shared = long.withColumn("noise", F.lit(OWN)).select(*key, "dim", "t", "y", "noise", F.lit(1).alias("_own"))
    shared = shared.unionByName(cross.select(*key, "dim", "t", "y", clip(OTHER / F.greatest("rho", F.lit(LEAST_AGREEMENT)), 0.5, 4.0).alias("noise"), F.lit(0).alias("_own")))
    # Evidence of the other seats that report, from their windows near by; m equal observations are one of a root of m less noise.
    single = None
    for d in dims:
        if d.evidence:
            events, value = (responses, "amplitude") if d.evidence == "response" else (directions, "shift")
            close = nearby_evidence(points, timed, events, place, "seat", "window", "t", value, near)
            hit = close.withColumn("dim", F.lit(d.name)).join(rho, [*key, "other", "dim"]).where((F.col("rho") >= 0.1) & ~gone)
            if d.evidence == "response":
                y, noise = F.lit(float(np.clip(d.mean + 2 * np.sqrt(d.variance), 1, 9))), clip(F.when(F.col("_value") > STRONG_FROM, STRONG).otherwise(WEAK) / F.col("rho"), 0.5, 4.0)
            else:
                y, noise = clip(d.mean + F.col("_value"), 1.0, 9.0), clip(DIRECTION / F.col("rho"), 1.0, 5.0)
            part = hit.select(*key, "t", "dim", "_at", y.alias("y"), (noise / F.sqrt("m")).alias("noise"), "m")
            single = part if single is None else single.unionByName(part)
    if single is None:
        single = live.select(*key, "t", "dim", F.col("t").alias("_at"), F.lit(0.0).alias("y"), F.lit(0.0).alias("noise"), F.lit(0).alias("m")).limit(0)
    post = posteriors(live, shared, single, key, "t", dims)
    counts = shared.groupBy(*key, "dim").agg(F.sum("_own").alias("n_own"), F.sum(1 - F.col("_own")).alias("n_other"))
    evidence = single.groupBy(*key, "t", "dim").agg(F.sum("m").alias("n_evidence"))
    # How far the nearest reports are, one's own and the others'.
    told = reports.select(*key, "t").distinct()
    theirs = told.withColumnRenamed("seat", "other").join(seats, place).where(F.col("seat") != F.col("other")).select(*key, "t").distinct()
    span = REACH / min(d.rate for d in dims)
    gap = lambda right, name: asof.nearest(points, right.withColumn("_v", F.lit(0)), key, "t", "_v", span).select(*key, "t", F.abs(F.col("near_at") - F.col("t")).alias(name))
    mean_rho = rho.groupBy(*key, "dim").agg(F.avg("rho").alias("_rho"))
    rows = post.join(evidence, [*key, "t", "dim"], "left").join(gap(told, "_near"), [*key, "t"], "left").join(gap(theirs, "_far"), [*key, "t"], "left")
    # Kept, as the label needs a percentile over all rows first.
    rows = timed.select(*key, "t", "window").join(rows, [*key, "t"]).localCheckpoint()
    widest = ranks.percentiles(rows, ["dim"], "alone", {"_most": 0.95}).select("dim", "_most")
    out = rows.join(F.broadcast(widest), "dim", "left").join(counts, [*key, "dim"], "left").join(mean_rho, [*key, "dim"], "left")
    rate, least = by_name({d.name: d.rate for d in dims}, F.col("dim")), by_name({d.name: d.least_weight for d in dims}, F.col("dim"))
    decay = lambda c: F.coalesce(F.exp(-rate * F.col(c)), F.lit(0.0))
    weight = F.least(F.greatest(clip(decay("_near") + F.coalesce("_rho", F.lit(0.0)) * decay("_far") * OTHERS_SHARE, 0.0, MOST_WEIGHT), least), F.lit(MOST_WEIGHT))
    heat = F.when(F.col("_most") >= 1e-8, clip(1 + (F.col("sigma") - OWN) / F.col("_most"), 1.0, 2.5)).otherwise(1.0)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    rows = out.select(*key, "window", "dim", "mu", "sigma", soft_label(F.col("mu"), F.col("sigma"), *cuts, heat).alias("soft"), weight.alias("weight"), zero("n_own"), zero("n_other"), zero("n_evidence"))
    third = F.array(*[F.lit(1 / 3)] * 3)
    none = each(timed).where(gone).select(*key, "window", "dim", F.lit(None).cast("double").alias("mu"), F.lit(None).cast("double").alias("sigma"), third.alias("soft"), F.lit(0.0).alias("weight"), *[F.lit(0).cast("long").alias(c) for c in ("n_own", "n_other", "n_evidence")])
    return rows.unionByName(none)

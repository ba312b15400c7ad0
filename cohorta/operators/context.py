"""Tables around the samples: answers, session events, signal maps, modality and context joins, reconciliation, selections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Keys of an answer that are no answers.
META_KEYS = ["type", "responses", "probe_name"]


def answer_rows(df: DataFrame, keys: list[str], payload: str, meta: list[str] = META_KEYS) -> DataFrame:
    """(keys, item, value) of JSON answers, by their type.

    vad: valence, arousal and dominance where they are there; postblock: the entries of responses;
    probe: probe_name, then all keys but ``meta``; any other: the entries of responses, then all
    keys but ``meta``. Text that is no JSON object gives nothing. Values are text as written.
    """
    m = F.from_json(payload, "map<string,string>")
    d = df.select(*keys, m.alias("_m")).where(F.col("_m").isNotNull())
    kind = F.lower(F.trim(F.coalesce(F.try_element_at("_m", F.lit("type")), F.lit(""))))
    responses = F.coalesce(F.map_entries(F.from_json(F.try_element_at("_m", F.lit("responses")), "map<string,string>")), F.array().cast("array<struct<key:string,value:string>>"))
    named = lambda f: F.map_entries(F.map_filter("_m", f))
    vad = named(lambda k, v: k.isin("valence", "arousal", "dominance") & v.isNotNull())
    rest = named(lambda k, v: ~k.isin(*meta))
    probe = F.concat(named(lambda k, v: (k == "probe_name") & v.isNotNull()), rest)
    rows = F.when(kind == "vad", vad).when(kind == "postblock", responses).when(kind == "probe", probe).otherwise(F.concat(responses, rest))
    return d.select(*keys, F.explode(rows).alias("e")).select(*keys, F.col("e.key").alias("item"), F.col("e.value").alias("value"))


def session_events(df: DataFrame, session: str, wall: str, described: dict[str, str]) -> DataFrame:
    """Adds onset, seconds since the session's first valid wall time, and description; rows without a valid time go.

    described: the column of each name in the description, in order; null counts as empty.
    """
    ok = df.where(F.col(wall) >= 0)
    text = F.concat_ws(";", *[F.concat(F.lit(f"{n}="), F.coalesce(F.col(c).cast("string"), F.lit(""))) for n, c in described.items()])
    first = ok.groupBy(session).agg(F.min(wall).alias("_t0"))
    return ok.join(first, session).withColumn("onset", F.col(wall) - F.col("_t0")).withColumn("description", text).drop("_t0")


def first_of(parts: list[DataFrame], keys: list[str], order: str) -> DataFrame:
    """Of several tables, one row a key: from the first table that has the key, its row of least ``order``."""
    each = [p.withColumn("_part", F.lit(i)) for i, p in enumerate(parts)]
    rest = [c for c in parts[0].columns if c not in keys]
    best = reduce(DataFrame.unionByName, each).groupBy(*keys).agg(F.min(F.struct("_part", order, *[c for c in rest if c != order])).alias("_b"))
    return best.select(*keys, *[F.col(f"_b.{c}").alias(c) for c in rest])


def outer_join(left: DataFrame, right: DataFrame, keys: list[str], suffixes: tuple[str, str]) -> DataFrame:
    """All keys of both tables; other columns that both have get the suffixes."""
    both = {c for c in left.columns if c in right.columns and c not in keys}
    name = lambda df, s: df.select(*keys, *[F.col(c).alias(f"{c}{s}" if c in both else c) for c in df.columns if c not in keys])
    return name(left, suffixes[0]).join(name(right, suffixes[1]), keys, "full")


def last_record_join(frames: DataFrame, records: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Frames with the last record of their number; frames or numbers without the other go."""
    rest = [c for c in records.columns if c not in keys]
    last = records.groupBy(*keys).agg(F.max(F.struct(order, *[c for c in rest if c != order])).alias("_l"))
    return frames.join(last.select(*keys, *[F.col(f"_l.{c}").alias(c) for c in rest]), keys)


def with_context(df: DataFrame, parts: list[tuple[DataFrame, list[str]]]) -> DataFrame:
    """Left joins with one context table after the other, each by its own keys."""
    return reduce(lambda d, p: d.join(p[0], p[1], "left"), parts, df)


def routed_seat(stream: Column, prefix: str) -> Column:
    """``P1`` to ``P4`` of a stream named exactly prefix, number, ``_stream``; else null."""
    n = F.regexp_extract(stream, rf"^\Q{prefix}\E([1-4])_stream$", 1)
    return F.when(n != "", F.concat(F.lit("P"), n))


def paired_correlations(pred: DataFrame, answers: DataFrame, keys: list[str], pairs: list[tuple[str, str]], least: int = 5) -> DataFrame:
    """Of each pair (prediction, answer) n, Pearson r and t over the joined rows that have both, ``least`` or more."""
    j = pred.join(answers, keys)
    each = j.select(F.explode(F.array(*[F.struct(F.lit(a).alias("prediction"), F.lit(b).alias("answer"), F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y")) for a, b in pairs])).alias("p")).select("p.*")
    ok = each.where("x is not null and y is not null").groupBy("prediction", "answer").agg(F.count("*").alias("n"), F.try_divide(F.covar_pop("x", "y"), F.stddev_pop("x") * F.stddev_pop("y")).alias("r"))
    return ok.where(F.col("n") >= least).withColumn("t", F.col("r") * F.sqrt(F.try_divide(F.col("n") - 2, 1 - F.col("r") ** 2)))


def frame_times(frames: DataFrame, log: DataFrame, windows: DataFrame, camera: str, frame: str, media: str) -> DataFrame:
    """Adds time and source: ``log`` where the frame log has the frame (column at), else ``window``: the clip's start and media time, else null."""
    out = frames.join(log.select(camera, frame, F.col("at").alias("_at")), [camera, frame], "left").join(windows.select(camera, F.col("start").alias("_start")), camera, "left")
    source = F.when(F.col("_at").isNotNull(), "log").when(F.col("_start").isNotNull(), "window")
    return out.withColumn("time", F.coalesce("_at", F.col("_start") + F.col(media))).withColumn("source", source).drop("_at", "_start")


def schedule_check(report: DataFrame, schedule: DataFrame, key: str) -> DataFrame:
    """Report rows (key, date, names) with the schedule's: dates OK or DIFF, names OK, PARTIAL, NO_NAMES or MISMATCH, and the differences.

    A group that is not scheduled has null for both. Names are compared as sets.
    """
    j = report.join(schedule.select(key, F.col("date").alias("_d"), F.col("names").alias("_n")), key, "left")
    both = F.size(F.array_intersect("names", "_n"))
    missing, extra = F.array_sort(F.array_except("_n", "names")), F.array_sort(F.array_except("names", "_n"))
    names = F.when(F.col("_n").isNull(), F.lit(None)).when(F.size("names") == 0, "NO_NAMES").when((F.size(missing) == 0) & (F.size(extra) == 0), "OK").when(both > 0, "PARTIAL").otherwise("MISMATCH")
    date = F.when(F.col("_n").isNull(), F.lit(None)).when(F.col("date").eqNullSafe(F.col("_d")), "OK").otherwise("DIFF")
    return j.select(key, date.alias("date_check"), names.alias("names_check"), F.array_join(missing, "|").alias("missing"), F.array_join(extra, "|").alias("extra"))


def alias_match(left: DataFrame, right: DataFrame, name: str, signature: str) -> DataFrame:
    """Sessions of two roots, matched by name, else by signature: high (both), medium (name), low (signature), single-source.

    A left row without its name on the right takes the least right name of its signature that no left row has by name.
    """
    l, r = left.select(F.col(name).alias("l_name"), F.col(signature).alias("l_sig")), right.select(F.col(name).alias("r_name"), F.col(signature).alias("r_sig"))  # noqa: E741
    by_name = l.join(r, F.col("l_name") == F.col("r_name"))
    free_l, free_r = l.join(r, F.col("l_name") == F.col("r_name"), "left_anti"), r.join(l, F.col("l_name") == F.col("r_name"), "left_anti")
    nth = lambda n, s: F.row_number().over(Window.partitionBy(s).orderBy(n))
    rest = free_l.withColumn("_k", nth("l_name", "l_sig")).join(free_r.withColumn("_k", nth("r_name", "r_sig")).withColumnRenamed("_k", "_j"), (F.col("l_sig") == F.col("r_sig")) & (F.col("_k") == F.col("_j")), "full").drop("_k", "_j")
    quality = F.when(F.col("l_name").isNull() | F.col("r_name").isNull(), "single-source").when((F.col("l_name") == F.col("r_name")) & F.col("l_sig").eqNullSafe(F.col("r_sig")), "high").when(F.col("l_name") == F.col("r_name"), "medium").otherwise("low")
    return by_name.unionByName(rest).select("l_name", "r_name", quality.alias("quality"))


def annotation_activity(df: DataFrame, keys: list[str], kind: str, onset: str, kinds: list[str]) -> DataFrame:
    """Per key: annotations, how many of each kind, and the span of onsets (two at least)."""
    span = F.when(F.count(onset) >= 2, F.max(onset) - F.min(onset))
    return df.groupBy(*keys).agg(F.count("*").alias("annotations"), *[F.count_if(F.col(kind) == k).alias(f"n_{k}") for k in kinds], span.alias("span"))


def inventory(df: DataFrame, group: str, session: str, phase: str, person: str, modality: str) -> DataFrame:
    """Per group: sessions, phases, people, and the modalities seen, in order."""
    return df.groupBy(group).agg(F.countDistinct(session).alias("sessions"), F.countDistinct(phase).alias("phases"), F.countDistinct(person).alias("people"), F.array_join(F.array_sort(F.collect_set(modality)), "|").alias("modalities"))


def evenly(df: DataFrame, keys: list[str], order: str, most: int) -> DataFrame:
    """At most ``most`` rows a key, at whole places i (n - 1) / (most - 1) of its order."""
    w = Window.partitionBy(*keys)
    d = df.withColumn("_r", F.row_number().over(w.orderBy(order)) - 1).withColumn("_n", F.count("*").over(w))
    if most == 1:
        return d.where("_r = 0").drop("_r", "_n")
    i = F.expr(f"(_r * {most - 1} + _n - 2) div greatest(_n - 1, 1)")
    return d.where((F.col("_n") <= most) | (F.floor(i * (F.col("_n") - 1) / (most - 1)) == F.col("_r"))).drop("_r", "_n")


def first_rows(df: DataFrame, keys: list[str], order: str, most: int) -> DataFrame:
    """The first ``most`` rows of each key: the row cap of a preview."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where(F.col("_r") <= most).drop("_r")


def first_sample(df: DataFrame, keys: list[str], order: str, values: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.min(order).alias(order), *[F.min_by(v, order).alias(v) for v in values])


def seeded_sample(df: DataFrame, key: str, seed: int, most: int) -> DataFrame:
    """``most`` rows in the order of a hash of seed and key: the same on any cluster."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key).limit(most)


def union_tables(tables: list[DataFrame]) -> DataFrame:
    """Tables one after the other; a column that one lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def compare_sets(a: Column, b: Column) -> Column:
    """(both, only_a, only_b, meet) of two arrays as sets, in order."""
    return F.struct(F.array_sort(F.array_intersect(a, b)).alias("both"), F.array_sort(F.array_except(a, b)).alias("only_a"), F.array_sort(F.array_except(b, a)).alias("only_b"), F.arrays_overlap(a, b).alias("meet"))


def without(df: DataFrame, held_out: DataFrame, keys: list[str], keep: bool = False) -> DataFrame:
    """The rows whose keys are not (keep: are) among the held-out ones."""
    return df.join(held_out.select(*keys), keys, "left_semi" if keep else "left_anti")

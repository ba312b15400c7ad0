"""The catalogue of recorded runs, the labelled window dataset, and classifiers validated by fold."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohorta.functions.scalars import entity
from cohorta.operators.joins import overlap_join, range_join
from cohorta.operators.windows import resampled

#: Folder and end of the name of each kind of file.
MEDIA = {"audio": ("audio", r"(?i)_(audio|aud)\.(wav|flac)$"), "video": ("video", r"(?i)_video\.(mkv|mp4|avi|mov)$"), "scene": ("et", r"(?i)_acq-[^_]+_tobii\.(mkv|mp4|avi|mov)$")}
RUN_FILES = {"events": ("beh", r"_events\.tsv$"), "gaze": ("et", r"\.tsv$"), "physio": ("physio", r"\.tsv(\.gz)?$")}
SESSION_FILES = {"windows": ("annot", r"_task_run_windows\.tsv$"), "signal_map": ("annot", r"_participant_signal_map\.tsv$"), "root_map": ("", r"participant_map\.tsv$"), "gestures": ("mocap", r"(?<=/)gestures_events\.ndjson$")}


def task_runs(files: DataFrame, path: str) -> DataFrame:
    """One row for each sub, ses, task and run with audio or video: audio, video, events, gaze, physio, windows, participant_map, gestures.

    Lists are sorted; of single files the first by name stands, null if there is none. Scene videos of eye
    trackers count as video. A run's gaze also holds its task's ``gaze.ndjson`` files, whatever their run; the map
    of a session's annotations goes before the one in its root. Files outside a session folder do not count.
    """
    p = F.col(path)
    inside = r"(?:^|/)(sub-[^/]+)/(ses-[^/]+)/"
    kinds = [("shared", ("et", r"task-[A-Za-z0-9]+_gaze\.ndjson$")), *{**MEDIA, **RUN_FILES, **SESSION_FILES}.items()]
    # One pattern a kind over the whole path, so that no name is cut out more than once.
    ends = [(k, f"{inside}{d}/[^/]*(?:{r})" if d else f"{inside}(?:{r})") for k, (d, r) in kinds]
    f = files.select(p.alias("p"), F.coalesce(*[F.when(p.rlike(r), k) for k, r in ends]).alias("kind")).where("kind is not null").distinct()
    f = f.select("p", "kind", F.regexp_extract("p", inside, 1).alias("sub"), F.regexp_extract("p", inside, 2).alias("ses"), entity(F.element_at(F.split("p", "/"), -1), "task").alias("task"), entity(F.element_at(F.split("p", "/"), -1), "run").alias("run"))
    each = f.where("task is not null and run is not null").groupBy("sub", "ses", "task", "run").agg(F.array_sort(F.collect_list(F.struct("p", "kind"))).alias("_f"))
    of = lambda *k: F.transform(F.filter("_f", lambda r: r["kind"].isin(*k)), lambda r: r["p"])
    each = each.select("sub", "ses", "task", "run", of("audio").alias("audio"), of("video", "scene").alias("video"), F.get(of("events"), 0).alias("events"), of("gaze").alias("gaze"), of("physio").alias("physio"))
    both = f.where("kind = 'shared' and task is not null").groupBy("sub", "ses", "task").agg(F.array_sort(F.collect_list("p")).alias("_g"))
    one = f.where(F.col("kind").isin(*SESSION_FILES)).groupBy("sub", "ses", "kind").agg(F.min("p").alias("p"))
    wide = one.groupBy("sub", "ses").agg(F.map_from_entries(F.collect_list(F.struct("kind", "p"))).alias("_m"))
    wide = wide.select("sub", "ses", F.col("_m")["windows"].alias("windows"), F.coalesce(F.col("_m")["signal_map"], F.col("_m")["root_map"]).alias("participant_map"), F.col("_m")["gestures"].alias("gestures"))
    runs = each.where("size(audio) > 0 or size(video) > 0").join(both, ["sub", "ses", "task"], "left").join(wide, ["sub", "ses"], "left")
    return runs.withColumn("gaze", F.concat("gaze", F.coalesce("_g", F.array().cast("array<string>")))).drop("_g")


def window_dataset(reports: DataFrame, samples: DataFrame, speech: DataFrame, traits: DataFrame, keys: list[str], report: str, at: str, value: str, spoken: tuple[str, str], width: int, length: int, least: int = 1) -> DataFrame:
    """The reports with the features of the ``width`` before them, both ends included, and all columns of traits.

    Adds n, mean, sd, min, max and slope (a unit of ``at``) of the values, ``sequence``, the values in order
    resampled to ``length`` points, and speech, the time of the key's utterances inside. Reports with fewer than
    ``least`` samples go; null values do not count. Only a window's samples meet in one place.
    """
    w = reports.select(*keys, report, (F.col(at) - width).alias("_a"), F.col(at).alias("_z"))
    hit = range_join(samples.where(F.col(value).isNotNull()).select(*keys, F.col(at).alias("_t"), F.col(value).cast("double").alias("_v")), w, keys, "_t", "_a", "_z", width, True)
    since = (F.col("_t") - F.col("_z")).cast("double")
    line = F.transform(F.array_sort(F.collect_list(F.struct("_t", "_v"))), lambda r: r["_v"])
    f = hit.groupBy(report).agg(
        F.count("*").alias("n"), F.avg("_v").alias("mean"), F.stddev_samp("_v").alias("sd"), F.min("_v").alias("min"), F.max("_v").alias("max"), F.regr_slope("_v", since).alias("slope"), line.alias("_line"),
    ).where(F.col("n") >= least).withColumn("sequence", resampled(F.col("_line"), length)).drop("_line")
    said = overlap_join(w, speech.select(*keys, F.col(spoken[0]).alias("_s"), F.col(spoken[1]).alias("_e")), keys, ("_a", "_z"), ("_s", "_e"), width)
    said = said.groupBy(report).agg(F.sum(F.least("_z", "_e") - F.greatest("_a", "_s")).alias("_said"))
    out = reports.join(f, report).join(said, report, "left").join(traits, keys, "left")
    return out.withColumn("speech", F.coalesce("_said", F.lit(0))).drop("_said")


def window_pool(windows: DataFrame, modalities: dict[str, tuple[DataFrame, str]], keys: list[str], window: str, start: str, end: str, at: str, length: int, least: int = 10) -> DataFrame:
    """The windows (keys, window, start, end) in which every modality has ``least`` samples or more, with features of each.

    modalities: name to (samples with keys and ``at``, value column). Of each the columns name_n, _mean, _sd, _min, _max, _slope (a unit of
    ``at``) and _sequence (values in order resampled to ``length`` points). A sample belongs to each window with start <= at < end;
    null values do not count. Buckets of the join are as long as the windows are on the average.
    """
    wide = windows.agg(F.greatest(F.avg(F.col(end) - F.col(start)), F.lit(1)).alias("w")).first()["w"] or 1
    w = windows.select(*keys, window, F.col(start).alias("_a"), F.col(end).alias("_z"))
    out = windows
    for name, (samples, value) in modalities.items():
        own = samples.where(F.col(value).isNotNull()).select(*keys, F.col(at).alias("_t"), F.col(value).cast("double").alias("_v"))
        hit = range_join(own, w, keys, "_t", "_a", "_z", wide)
        line = F.transform(F.array_sort(F.collect_list(F.struct("_t", "_v"))), lambda r: r["_v"])
        f = hit.groupBy(*keys, window).agg(
            F.count("*").alias(f"{name}_n"), F.avg("_v").alias(f"{name}_mean"), F.stddev_samp("_v").alias(f"{name}_sd"), F.min("_v").alias(f"{name}_min"), F.max("_v").alias(f"{name}_max"),
            F.regr_slope("_v", (F.col("_t") - F.col("_a")).cast("double")).alias(f"{name}_slope"), line.alias("_line"),
        ).where(F.col(f"{name}_n") >= least).withColumn(f"{name}_sequence", resampled(F.col("_line"), length)).drop("_line")
        out = out.join(f, [*keys, window])
    return out


def fold_scores(df: DataFrame, fold: str, features: list[str], label: str, pool: DataFrame | None = None, weight: str = "weight", penalty: float = 0.01, least: int = 3, most: int = 100) -> DataFrame:
    """fold, n and macro_f1 of a multinomial logistic classifier trained on all other folds.

    ``pool`` adds weighted rows, of training folds only. Scaling is fitted to the training rows, weights aside.
    Labels are whole numbers from 0; rows with a missing value do not count. The mean is over labels that occur
    or are predicted; a fold with fewer than ``least`` training rows of its own table, or with one label only
    in training, scores 0. Every fold is a fit over all rows, so more than ``most`` folds are refused.
    """
    rows = VectorAssembler(inputCols=features, outputCol="_x").transform(df.dropna(subset=[fold, label, *features])).select(F.col(fold).alias("fold"), F.col(label).cast("double").alias("y"), "_x", F.lit(1.0).alias("_w"))
    names = [r[0] for r in rows.select("fold").distinct().limit(most + 1).collect()]
    if len(names) > most:
        raise ValueError(f"more than {most} folds")
    more = None if pool is None else VectorAssembler(inputCols=features, outputCol="_x").transform(pool.dropna(subset=[fold, label, weight, *features])).select(F.col(fold).alias("fold"), F.col(label).cast("double").alias("y"), "_x", F.col(weight).cast("double").alias("_w"))
    seen = []
    for k in sorted(names):
        own, test = rows.where(F.col("fold") != F.lit(k)), rows.where(F.col("fold") == F.lit(k))
        train = own if more is None else own.unionByName(more.join(own.select("fold").distinct(), "fold", "left_semi"))
        n = own.agg(F.count("*"), F.count_distinct("y")).first()
        if n[0] < least or n[1] < 2:
            seen.append(test.select("fold", "y", F.lit(None).cast("double").alias("prediction")))
            continue
        scaler = StandardScaler(inputCol="_x", outputCol="features", withMean=True, withStd=True).fit(train)
        model = LogisticRegression(featuresCol="features", labelCol="y", weightCol="_w", family="multinomial", regParam=penalty).fit(scaler.transform(train))
        seen.append(model.transform(scaler.transform(test)).select("fold", "y", "prediction"))
    if not seen:
        return rows.select("fold", F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("macro_f1"))
    c = reduce(DataFrame.unionByName, seen).groupBy("fold", "y", "prediction").agg(F.count("*").alias("c"))
    each = c.select("fold", F.explode(F.array(*[F.struct(F.col(a).alias("label"), F.lit(s).alias("side"), (F.col("y") == F.col("prediction")).alias("hit"), F.col("c").alias("c")) for s, a in enumerate(("y", "prediction"))])).alias("e")).select("fold", "e.*").where("label is not null")
    f1 = each.groupBy("fold", "label").agg((F.sum(F.when(F.col("hit"), F.col("c")).otherwise(0)) / F.sum("c")).alias("f1"), F.sum(F.when(F.col("side") == 0, F.col("c")).otherwise(0)).alias("n"))
    return f1.groupBy("fold").agg(F.sum("n").alias("n"), F.avg("f1").alias("macro_f1"))

"""Scans and sinks of recordings: sample tables, gaze packets, logs, annotations, inventories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohorta.functions.scalars import entity, finite


def sample_table(spark: SparkSession, path: str, channels: list[str], time: str = "lsl_time") -> DataFrame:
    """TSV, gzipped or not, with a header: time and the channels wanted as finite doubles, and file entities.

    Channels that a file lacks are null. Every file is read once; nothing is sorted here, as
    operators order by time where they need it.
    """
    raw = spark.read.option("header", True).option("sep", "\t").csv(path)
    wanted = list(dict.fromkeys([time, *channels]))
    cols = [finite(F.col(f"`{c}`")).alias(c) if c in raw.columns else F.lit(None).cast("double").alias(c) for c in wanted]
    return raw.select(*cols, *file_entities(F.col("_metadata.file_path")))


def file_entities(path: Column) -> list[Column]:
    """session, task and seat that a file's path names; null where it names none."""
    return [entity(path, "ses").alias("session"), entity(path, "task").alias("task"), entity(path, "acq").alias("seat")]


def conform(df: DataFrame, base: list[str], width: int) -> DataFrame:
    """Rows with an array of values as ``base`` and value_0 .. value_(width - 1); short rows are padded."""
    return df.select(*base, *[F.get("values", k).alias(f"value_{k}") for k in range(width)])


GAZE = "timestamp double, data struct<gaze2d array<double>, gaze3d array<double>, eyeleft struct<pupildiameter double>, eyeright struct<pupildiameter double>>"


def gaze_packets(spark: SparkSession, path: str, ticks_per_second: float | None = None) -> DataFrame:
    """Nested gaze packets, one a line: seconds, gaze point, 3-D point (three numbers only), pupils."""
    raw = spark.read.schema(GAZE).json(path)
    g3, g2 = F.col("data.gaze3d"), F.col("data.gaze2d")
    point = lambda k: F.when(F.size(g3) == 3, F.get(g3, k))
    t = F.col("timestamp") / ticks_per_second if ticks_per_second else F.col("timestamp")
    return raw.where("timestamp is not null").select(t.alias("t"), F.get(g2, 0).alias("gx"), F.get(g2, 1).alias("gy"), point(0).alias("x"), point(1).alias("y"), point(2).alias("z"), F.col("data.eyeleft.pupildiameter").alias("pupil_left"), F.col("data.eyeright.pupildiameter").alias("pupil_right"))


def write_gaze_packets(df: DataFrame, path: str, by: str) -> None:
    """Packets as JSON lines, a folder for each ``by``; rows without gaze go, null fields are left out."""
    packet = F.to_json(F.struct(F.col("t").alias("timestamp"), F.array("gx", "gy").alias("gaze2d"), "pupil_left", "pupil_right"))
    df.where("gx is not null and gy is not null and not isnan(gx) and not isnan(gy)").select(by, packet.alias("value")).write.partitionBy(by).text(path)


def frame_log(spark: SparkSession, path: str, kind: str = "json") -> DataFrame:
    """frame, pts_time, lsl_clock, unix_time, media_time_us of a log of frames, JSON lines or TSV."""
    schema = "frame long, pts_time double, lsl_clock double, unix_time double, media_time_us long"
    reader = spark.read.schema(schema)
    return reader.json(path) if kind == "json" else reader.option("header", True).option("sep", "\t").csv(path)


def world_gaze(df: DataFrame, device: str) -> DataFrame:
    """Per device: rows, rows with a finite point and time, ranges and medians."""
    p = [finite(F.get("world_point_m", k)) for k in range(3)]
    ok = (F.size("world_point_m") == 3) & p[0].isNotNull() & p[1].isNotNull() & p[2].isNotNull() & finite(F.col("t")).isNotNull()
    own = lambda c: F.when(ok, c)
    return df.groupBy(device).agg(F.count("*").alias("rows"), F.sum(ok.cast("long")).alias("kept"), F.min(own(F.col("t"))).alias("first"), F.max(own(F.col("t"))).alias("last"), F.median(own(p[0])).alias("x_median"), F.median(own(p[1])).alias("y_median"))


ANNOTATIONS = "session string, task string, tiers array<struct<name: string, entries: array<struct<start: double, end: double, label: string>>>>"


def annotations(spark: SparkSession, path: str) -> DataFrame:
    """One row an entry of annotation documents, one document a file; missing tiers or entries give none."""
    docs = spark.read.schema(ANNOTATIONS).option("multiLine", True).json(path)
    return docs.select("session", "task", F.explode("tiers").alias("t")).select("session", "task", F.col("t.name").alias("tier"), F.explode("t.entries").alias("e")).select("session", "task", "tier", "e.*")


def write_annotations(entries: DataFrame, path: str) -> None:
    """Entries back to one JSON document a session and task, as a line of text each."""
    tier = entries.groupBy("session", "task", "tier").agg(F.array_sort(F.collect_list(F.struct("start", "end", "label"))).alias("entries"))
    doc = tier.groupBy("session", "task").agg(F.array_sort(F.collect_list(F.struct(F.col("tier").alias("name"), "entries"))).alias("tiers"))
    doc.select(F.to_json(F.struct("session", "task", "tiers")).alias("value")).write.text(path)


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """Files and bytes by session, task and kind (the file's ending); contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    kind = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)(?:\.gz)?$", 1))
    e = files.select(*file_entities(F.col("path")), kind.alias("kind"), "length", "path")
    return e.groupBy("session", "task", "kind").agg(F.count("*").alias("files"), F.sum("length").alias("bytes"), F.array_sort(F.collect_list("path")).alias("paths"))


def write_streams(df: DataFrame, path: str, keys: list[str]) -> None:
    """Rows to one folder a category, as Parquet, clustered first so that few files are written."""
    df.repartition(*keys).write.partitionBy(*keys).parquet(path)


def write_table(df: DataFrame, path: str, keys: list[str]) -> None:
    """A sorted TSV for people to read; the working format is Parquet."""
    df.orderBy(*keys).write.option("header", True).option("sep", "\t").csv(path)


def write_report(df: DataFrame, path: str, by: str) -> None:
    """One JSON object a line for each ``by``."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.text(path)


def exported_seconds(c: Column) -> Column:
    """Six decimals, or blank where there is no clock."""
    return F.coalesce(F.format_string("%.6f", c), F.lit(""))

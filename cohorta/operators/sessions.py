"""Sessions as recorded: markers as events, durations, capture starts, logs, clocks, seats, and the report row of a session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TASKS = ("T0", "T1", "T2", "T3", "T4")
SEATS = ("P1", "P2", "P3", "P4")
#: What a payload's field may hold and still say nothing.
_SAYS_NOTHING = ("", "0", "0.0", "false", "[]", "{}")


def marker_events(markers: DataFrame, stream: str, value: str, clock: str, tasks: tuple[str, ...] = TASKS) -> DataFrame:
    """Adds wall, task, phase, event_type and participant, read from a marker's value.

    A value that starts with ``{`` and is whole JSON is a payload; any other gives empty fields. ``wall``
    is the payload's wall clock, else the stream's own time; null if that is no number. A marker of an
    experiment stream without a task takes the first of ``tasks`` that its value names in any case.
    """
    text = F.coalesce(F.col(value), F.lit(""))
    payload = F.try_parse_json(F.when(text.startswith("{"), text))

    def field(name: str) -> Column:
        v = F.try_variant_get(payload, f"$.{name}", "string")
        return F.when(v.isNull() | v.isin(*_SAYS_NOTHING), "").otherwise(v)

    named = F.lit("")
    for t in reversed(tasks):
        named = F.when(F.contains(F.upper(text), F.lit(t)), t).otherwise(named)
    asked = (field("task") == "") & F.contains(F.lower(F.coalesce(F.col(stream), F.lit(""))), F.lit("experiment"))
    wall = F.when(field("wall_clock") != "", field("wall_clock")).otherwise(F.col(clock).cast("string"))
    more = {"wall": wall.try_cast("double"), "task": F.when(asked, named).otherwise(field("task"))}
    return markers.withColumns(more | {n: field(n) for n in ("phase", "event_type", "participant")})


def run_durations(events: DataFrame, keys: list[str], run: str, task: str, wall: str, tasks: tuple[str, ...] = TASKS) -> DataFrame:
    """Per key: runs, total, and for each task its seconds, from the longest run of each.

    A run's span of a task, or of all its events, is its last less its first wall clock that is not
    negative, two at least; spans of several runs are never joined, as a restart lies between them. A
    task without a positive span is null; a key without any span has a total of 0.
    """
    own = F.upper(F.trim(F.coalesce(F.col(task), F.lit(""))))
    at = F.when(F.col(wall) >= 0, F.col(wall))
    part = events.groupBy(*keys, run, own.alias("_task")).agg(F.min(at).alias("_a"), F.max(at).alias("_z"), F.count(at).alias("_n"))
    span = F.when(F.col("_n") >= 2, F.col("_z") - F.col("_a"))
    per_run = part.groupBy(*keys, run).agg(
        F.when(F.sum("_n") >= 2, F.max("_z") - F.min("_a")).alias("_total"),
        *[F.max(F.when((F.col("_task") == t) & (span > 0), span)).alias(f"{t}_s") for t in tasks],
    )
    return per_run.groupBy(*keys).agg(F.count("*").alias("runs"), F.coalesce(F.max("_total"), F.lit(0.0)).alias("total_s"), *[F.max(f"{t}_s").alias(f"{t}_s") for t in tasks])


def stream_duration(df: DataFrame, keys: list[str], order: list[str], at: str) -> DataFrame:
    """Per key: the time of the last row that has one less that of the first, in reading order, never negative; null without any."""
    place = F.when(F.col(at).isNotNull(), F.struct(*order))
    span = F.max_by(at, place) - F.min_by(at, place)
    return df.groupBy(*keys).agg(F.when(span.isNotNull(), F.greatest(F.lit(0.0), span)).alias("duration_s"))


def event_duration(df: DataFrame, keys: list[str], onset: str, duration: str, absolute: float = 1e6) -> DataFrame:
    """Per key: the latest end of its events, less the earliest absolute onset (above ``absolute``) where there is one.

    Missing onsets and durations are 0: a first marker at 0 may stand among absolute onsets and is no start then.
    """
    o, d = F.coalesce(F.col(onset), F.lit(0.0)), F.coalesce(F.col(duration), F.lit(0.0))
    end, start = F.greatest(F.lit(0.0), F.max(o + d)), F.min(F.when(o > absolute, o))
    return df.groupBy(*keys).agg(F.when(start.isNull(), end).otherwise(F.greatest(F.lit(0.0), end - start)).alias("duration_s"))


def window_total(df: DataFrame, keys: list[str], duration: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.sum(F.coalesce(F.col(duration), F.lit(0.0))).alias("duration_s"))


def latest_run(starts: DataFrame, keys: list[str], us: str, gap_us: int) -> DataFrame:
    """Per key: when its last run begins; more than ``gap_us`` without a start ends a run.

    Starts are first put into buckets of ``gap_us``, within which no run ends, so what is sorted is one row a bucket.
    """
    b = starts.groupBy(*keys, F.floor(F.col(us) / gap_us).alias("_b")).agg(F.min(us).alias("_a"), F.max(us).alias("_z"))
    before = F.lag("_z").over(Window.partitionBy(*keys).orderBy("_b"))
    new = F.when(before.isNull() | (F.col("_a") - before > gap_us), F.col("_a"))
    return b.withColumn("_new", new).groupBy(*keys).agg(F.max("_new").alias("run_us"))


def capture_report(events: DataFrame, keys: list[str], device: str, kind: str, us: str, line: str, gap_us: int = 300_000_000) -> DataFrame:
    """Per device of a key: start, offset_ms to the first device, duration_s, status, and the key's rating.

    Only starts (``capture_started``) of the latest run count, of each device the last. ``duration_s`` reaches
    to the last ``capture_completed`` in a line behind that start. Status is Completed, Running or No start.
    The rating goes by the largest offset: excellent below 100 ms, good below 500, acceptable below 1000, else
    poor; null without a start. Rows without a device only tell runs apart.
    """
    starts = events.where((F.col(kind) == "capture_started") & F.col(us).isNotNull())
    own = starts.join(latest_run(starts, keys, us, gap_us), keys).where((F.col(us) >= F.col("run_us")) & F.col(device).isNotNull())
    begun = own.groupBy(*keys, device).agg(F.max(us).alias("start_us"), F.max_by(F.col(line), F.struct(F.col(us), -F.col(line))).alias("_line"))
    ends = begun.groupBy(*keys).agg(F.min("start_us").alias("_first"), F.max("start_us").alias("_last"))
    done = F.when((F.col(kind) == "capture_completed") & (F.col(line) > F.col("_line")), F.struct(F.col(line).alias("l"), F.col(us).alias("u")))
    named = events.where(F.col(device).isNotNull()).select(*keys, device, kind, us, line)
    out = named.join(begun, [*keys, device], "left").groupBy(*keys, device, "start_us").agg(F.max(done)["u"].alias("_done")).join(ends, keys, "left")
    most = (F.col("_last") - F.col("_first")) / 1000
    rating = F.when(most < 100, "excellent").when(most < 500, "good").when(most < 1000, "acceptable").when(most.isNotNull(), "poor")
    status = F.when(F.col("start_us").isNull(), "No start").when(F.col("_done").isNull(), "Running").otherwise("Completed")
    return out.select(*keys, device, "start_us", ((F.col("start_us") - F.col("_first")) / 1000).alias("offset_ms"), ((F.col("_done") - F.col("start_us")) / 1e6).alias("duration_s"), status.alias("status"), rating.alias("rating"))


def preferred_log(table: DataFrame, lines: DataFrame, keys: list[str], order: str, clock: str, media: str, fall: float = 0.5) -> DataFrame:
    """Keys with (clock, media in microseconds, source) of the log that counts: the table's last segment, else the lines.

    Table rows without clock or media (seconds) are passed over; a fall of media by more than ``fall`` opens a segment.
    A key whose table has no usable row takes its lines (media in microseconds) as they are.
    """
    rows = table.where(F.col(clock).isNotNull() & F.col(media).isNotNull())
    w = Window.partitionBy(*keys).orderBy(order)
    falls = rows.withColumn("_cut", F.when(F.col(media) + fall < F.lag(media).over(w), F.col(order)))
    last = falls.groupBy(*keys).agg(F.max("_cut").alias("_from"))
    kept = rows.join(last, keys).where(F.col("_from").isNull() | (F.col(order) >= F.col("_from")))
    one = kept.select(*keys, order, clock, (F.col(media) * 1_000_000).cast("long").alias("media_us"), F.lit("table").alias("source"))
    return one.unionByName(lines.join(last, keys, "left_anti").select(*keys, order, clock, F.col("media_us").cast("long").alias("media_us"), F.lit("lines").alias("source")))


def anchored_delay(frames: DataFrame, anchors: DataFrame, keys: list[str], clock: str, unix: str, pts: str) -> DataFrame:
    """Per key of frames: method, n, delay_s, mad_s, drift_ms_min and offset_s advised.

    ``anchor``, where the key has anchors (``clock`` and ``media_us``, neither null): delays of a frame's
    clock behind pts and the median of clock - media. ``frame`` otherwise: only how steady unix - pts is, with
    an offset of 0; frames without a unix time (null or 0) say nothing, and a key without any has neither.
    """
    mid = lambda c: F.percentile(c, F.lit(0.5))
    zero = anchors.groupBy(*keys).agg(mid(F.col(clock) - F.col("media_us") / 1e6).alias("_zero"))
    start = F.when(F.col(unix) != 0, F.col(unix) - F.col(pts))
    delay = F.when(F.col("_zero").isNotNull(), F.col(clock) - F.col(pts) - F.col("_zero")).otherwise(start)
    f = frames.join(zero, keys, "left").withColumn("_d", delay)
    mids = f.groupBy(*keys).agg(mid("_d").alias("_mid"), F.avg(pts).alias("_p"))
    e = f.join(mids, keys).withColumn("_c", F.col(pts) - F.col("_p"))
    got = e.groupBy(*keys, "_zero", "_mid").agg(F.count("*").alias("n"), mid(F.abs(F.col("_d") - F.col("_mid"))).alias("mad_s"), F.regr_slope(F.col("_d"), F.col("_c")).alias("_slope"))
    anchored, known = F.col("_zero").isNotNull(), F.col("_mid").isNotNull()
    return got.select(
        *keys, F.when(anchored, "anchor").when(known, "frame").alias("method"), "n", F.when(anchored, F.col("_mid")).alias("delay_s"), "mad_s",
        F.when(anchored, F.col("_slope") * 60_000).alias("drift_ms_min"), F.when(anchored, -F.col("_mid")).when(known, 0.0).alias("offset_s"),
    )


def seated_windows(windows: DataFrame, seats: DataFrame, keys: list[str], order: str, seat: str, tasks: tuple[str, ...] = TASKS) -> DataFrame:
    """A row for each of ``tasks`` and seat of a key: start, end, the key's first offset, and the seat table's columns.

    The last row of a task counts; the offset is that of the first row that has one, of whatever task. A key without seats keeps its windows.
    """
    task = F.trim("task")
    first = windows.groupBy(*keys).agg(F.min_by("offset", F.when(F.col("offset").isNotNull(), F.col(order))).alias("offset"))
    last = windows.where(task.isin(*tasks)).groupBy(*keys, task.alias("task")).agg(F.max_by(F.struct("start", "end"), order).alias("_w"))
    out = last.join(first, keys).select(*keys, "task", "_w.start", "_w.end", "offset")
    return out.join(seats.select(*keys, seat, *[c for c in seats.columns if c not in {*keys, seat, *out.columns}]), keys, "left")


def screen_fixations(df: DataFrame, keys: list[str], order: list[str], x: str, y: str, rate: float, most_speed: float = 0.1, least: int = 3) -> DataFrame:
    """Fixations on a screen by speed from sample to sample at ``rate`` Hz: first and end place, duration_ms, centre, dispersion.

    A sample is slow below ``most_speed`` to the one before; a key's first is slow; one without a point is not.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    step = F.sqrt((F.col(x) - F.lag(x).over(w)) ** 2 + (F.col(y) - F.lag(y).over(w)) ** 2) * rate
    s = df.withColumn("_i", F.row_number().over(w) - 1).withColumn("_slow", (F.col("_i") == 0) | F.coalesce(step < most_speed, F.lit(False)))
    fast = s.withColumn("_run", F.sum((~F.col("_slow")).cast("long")).over(w)).where("_slow")
    spread = F.max(x) - F.min(x) + F.max(y) - F.min(y)
    out = fast.groupBy(*keys, "_run").agg(F.min("_i").alias("first"), (F.max("_i") + 1).alias("end"), F.count("*").alias("n"), F.avg(x).alias("cx"), F.avg(y).alias("cy"), spread.alias("dispersion"))
    return out.where(F.col("n") >= least).select(*keys, "first", "end", (F.col("n") / rate * 1000).alias("duration_ms"), "cx", "cy", "dispersion")


def gated_joints(df: DataFrame, point: list[str], confidence: str, error: str, cameras: str, joint: str, body: list[int] | None = None, least: float = 0.3, most_error: float = 20.0, least_cameras: int = 2) -> DataFrame:
    """Nulls the points of joints that fail; adds had, and why: low_confidence, high_error, few_cameras, off_body.

    The first three can hold at once; a joint outside ``body`` (None: all joints count) is not asked for them.
    An error below 0 is unknown and passes; a null measure passes.
    """
    had = F.col(point[0]).isNotNull()
    off = F.lit(False) if body is None else ~F.col(joint).isin(*body)
    no = lambda c: F.coalesce(had & ~off & c, F.lit(False))
    why = {"low_confidence": no(F.col(confidence) < least), "high_error": no((F.col(error) >= 0) & (F.col(error) > most_error)), "few_cameras": no(F.col(cameras) < least_cameras), "off_body": had & off}
    fails = why["low_confidence"] | why["high_error"] | why["few_cameras"] | off
    return df.withColumns({"had": had} | why | {c: F.when(~fails, F.col(c)) for c in point})


def gate_counts(gated: DataFrame, keys: list[str], point: str) -> DataFrame:
    """Per key of ``gated_joints``: points before and after, removed, and how many each reason removed (not exclusive)."""
    before, after = F.count_if("had"), F.count(point)
    return gated.groupBy(*keys).agg(before.alias("before"), after.alias("after"), (before - after).alias("removed"), *[F.count_if(c).alias(c) for c in ("low_confidence", "high_error", "few_cameras", "off_body")])


def _names(c: Column) -> Column:
    """Names without case and outer or doubled spaces, each once, in order."""
    plain = F.transform(c, lambda n: F.lower(F.trim(F.regexp_replace(n, r"\s+", " "))))
    return F.array_sort(F.array_distinct(F.filter(plain, lambda n: n != "")))


def session_rows(
    sessions: DataFrame, schedule: DataFrame, streams: DataFrame, recordings: DataFrame, durations: DataFrame, key: str, group: str,
    seats: tuple[str, ...] = SEATS, tasks: tuple[str, ...] = TASKS, kinds: tuple[str, ...] = ("gaze", "sensor", "aggregate", "markers"),
) -> DataFrame:
    """The report row of every session (key, group, date, names, candidates), one row a key.

    * ``schedule`` (group, date, names): date_match yes or no; names_match yes, partial, no_names or mismatch; both null without one.
    * ``streams`` (key, kind, seat, duration_s): streams by kind, others, in all, the longest; gaze by seat yes or no, physio streams by seat.
    * ``recordings`` (key, recording, seat, mb, video): a seat's videos as ``name(12MB)``, in order of name.
    * ``durations``: as ``run_durations`` gives them.

    ``notes`` says what is missing: the schedule's differences, seats without streams (where the session
    has any), seats without a video (where it has candidates), tasks, and runs that were merged.
    """
    plan = schedule.select(group, F.col("date").alias("_date"), F.col("names").alias("_names"))
    is_ = lambda k, s: (F.col("kind") == k) & (F.col("seat") == s)
    physio = lambda s: F.col("kind").isin("sensor", "aggregate") & (F.col("seat") == s)
    found = streams.groupBy(key).agg(
        F.count("*").alias("streams"), F.max("duration_s").alias("longest_s"), *[F.count_if(F.col("kind") == k).alias(f"{k}_streams") for k in kinds],
        F.count_if(~F.coalesce(F.col("kind").isin(*kinds), F.lit(False))).alias("other_streams"),
        *[F.count_if(is_("gaze", s)).alias(f"_gaze_{s}") for s in seats], *[F.count_if(physio(s)).alias(f"physio_{s}") for s in seats],
    )
    entry = F.concat("recording", F.lit("("), F.round("mb").cast("long").cast("string"), F.lit("MB)"))
    clips = recordings.where("video").groupBy(key).agg(*[F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("seat") == s, F.struct("recording", entry.alias("e"))))), lambda r: r["e"]), ";").alias(f"video_{s}") for s in seats])
    row = sessions.join(plan, group, "left").join(found, key, "left").join(clips, key, "left").join(durations, key, "left")
    ours, theirs = _names(F.coalesce("names", F.array().cast("array<string>"))), _names(F.coalesce("_names", F.array().cast("array<string>")))
    scheduled, shared = F.col("_date").isNotNull() | F.col("_names").isNotNull(), F.size(F.array_intersect(ours, theirs)) > 0
    date_match = F.when(scheduled, F.when(F.col("date").eqNullSafe(F.col("_date")), "yes").otherwise("no"))
    names_match = F.when(scheduled, F.when(ours == theirs, "yes").when(shared, "partial").when(F.size(ours) == 0, "no_names").otherwise("mismatch"))
    differ = F.array_sort(F.array_union(F.array_except(ours, theirs), F.array_except(theirs, ours)))
    any_stream, no_video = F.col("streams") > 0, lambda s: F.coalesce(F.col(f"video_{s}"), F.lit("")) == ""
    lacking = F.array_compact(F.array(*[F.when(F.col(f"{t}_s").isNull(), t) for t in tasks]))
    text = lambda *c: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in c])
    notes = F.array_compact(F.array(
        F.when(date_match == "no", text("date mismatch: scheduled ", F.coalesce(F.col("_date").cast("string"), F.lit("")), ", actual ", F.coalesce(F.col("date").cast("string"), F.lit("")))),
        F.when(names_match == "partial", text("name diff: ", F.array_join(differ, ", "))).when(names_match == "mismatch", "names mismatch vs schedule"),
        *[F.when(any_stream & (F.col(c) == 0), f"missing {w} {s}") for s in seats for c, w in ((f"_gaze_{s}", "gaze"), (f"physio_{s}", "physio"))],
        *[F.when((F.col("candidates") > 0) & no_video(s), f"video {s} unmatched") for s in seats],
        F.when(F.col("runs").isNull(), "no experiment events").when(F.size(lacking) > 0, text("missing tasks: ", F.array_join(lacking, ","))),
        F.when(F.col("runs") > 1, text("merged from ", F.col("runs").cast("string"), " runs")),
    ))
    return row.select(
        key, group, date_match.alias("date_match"), names_match.alias("names_match"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("streams", *[f"{k}_streams" for k in kinds], "other_streams")], "longest_s",
        *[F.when(any_stream, F.when(F.col(f"_gaze_{s}") > 0, "yes").otherwise("no")).alias(f"gaze_{s}") for s in seats], *[F.coalesce(f"physio_{s}", F.lit(0)).alias(f"physio_{s}") for s in seats],
        *[F.coalesce(f"video_{s}", F.lit("")).alias(f"video_{s}") for s in seats],
        F.array_join(F.array_compact(F.array(*[F.when(F.col(f"{t}_s").isNotNull(), t) for t in tasks])), ";").alias("tasks_found"), *[f"{t}_s" for t in tasks], "total_s",
        F.array_join(notes, "; ").alias("notes"),
    )

"""Column functions: coercion, cleaning, labels, flags, geometry, soft labels. All stay in Catalyst."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- cleaning ---------------------------------------------------------------------------------


def finite(c: Column) -> Column:
    """The value as a double; text that is no number, NaN and infinities become null."""
    d = c.try_cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) != float("inf")), d)


def in_range(c: Column, low: float, high: float, sentinel: float | None = None) -> Column:
    """Values outside [low, high], or as large as the sentinel, become null."""
    ok = c.between(low, high)
    return F.when(ok if sentinel is None else ok & (F.abs(c) < sentinel), c)


def pair_mean(a: Column, b: Column) -> Column:
    """Mean of the values there are; null if there is none."""
    return F.coalesce((a + b) / 2, a, b)


def mean_of(*parts: Column) -> Column:
    """Row-wise mean of the non-null parts; null if there is none."""
    there = F.filter(F.array(*parts), lambda x: x.isNotNull())
    return F.try_divide(F.aggregate(there, F.lit(0.0), lambda s, x: s + x), F.size(there))


def minus_means(positive: list[Column], negative: list[Column]) -> Column:
    """Mean of the positive parts less that of the negative ones (none: 0)."""
    return mean_of(*positive) - F.coalesce(mean_of(*negative), F.lit(0.0))


# --- labels -----------------------------------------------------------------------------------


def three_way(c: Column, low: float, high: float, missing: str | None = None) -> Column:
    """``Low`` up to low, ``High`` from high on, else ``Moderate``; null gives ``missing``."""
    return F.when(c.isNull(), F.lit(missing)).when(c <= low, "Low").when(c >= high, "High").otherwise("Moderate")


def z_label(z: Column, missing: str = "Unknown") -> Column:
    return three_way(z, -1.0, 1.0, missing)


def rating_label(c: Column, low: float = 3, high: float = 7) -> Column:
    return three_way(c, low, high)


def rating_class(c: Column, t1=4.0, t2=6.0, missing: int = 1) -> Column:
    """0 up to t1, 1 up to t2, else 2; null gives ``missing``. Thresholds may be columns."""
    return F.when(c.isNull(), F.lit(missing)).when(c <= t1, 0).when(c <= t2, 1).otherwise(2)


def adaptive_class(c: Column, t1: Column, t2: Column) -> Column:
    """rating_class with thresholds that may be null, which stand for the fixed ones."""
    return rating_class(c, F.coalesce(t1, F.lit(4.0)), F.coalesce(t2, F.lit(6.0)))


def flags(**tests: Column) -> Column:
    """The names of the tests that hold, in the order given, as an array."""
    return F.array_compact(F.array(*[F.when(t, F.lit(n)) for n, t in tests.items()]))


def flag_text(found: Column) -> Column:
    return F.when(F.size(found) > 0, F.array_join(found, ";")).otherwise("ok")


def flag_notes(found: Column, sentences: dict[str, str]) -> Column:
    """Each flag's sentence, repeated ones once, in order; unknown flags have none."""
    table = F.create_map(*[F.lit(x) for kv in sentences.items() for x in kv])
    return F.array_join(F.array_distinct(F.array_compact(F.transform(found, lambda f: F.get(F.array(table[f]), 0)))), " ")


def decibels(rms: Column, floor: float = -80.0) -> Column:
    return F.greatest(20 * F.log10(F.greatest(rms, F.lit(1e-10))), F.lit(floor))


# --- text and names -----------------------------------------------------------------------------

#: Stream kinds by the beginning of the name, in the order that they are tried.
STREAM_NAMES = [
    ("tobii", "(?i)^Tobii[_-]"),
    ("emotibit", "(?i)^Emotibit[_-]"),
    ("vicon", "(?i)^Vicon"),
]
SYNC_NAMES = "(?i)^(ffmpeg|dpa)[_-]"
SYNC_TYPES = ["clock", "ffmpeg_progress"]


def stream_kind(name: Column, kind: Column, own_prefix: str | None = None) -> Column:
    """Kind by the beginning of the name, else by the whole type; markers are also all of the study's own streams.

    Last, names that speak of an eye tracker anywhere; else ``other``. Null counts as empty.
    """
    n, k = F.trim(F.coalesce(name, F.lit(""))), F.lower(F.trim(F.coalesce(kind, F.lit(""))))
    tests = [F.when(n.rlike(p), F.lit(v)) for v, p in STREAM_NAMES]
    own = F.lower(n).startswith(own_prefix.lower()) if own_prefix else F.lit(False)
    tests += [F.when(own | (k == "markers"), "markers"), F.when(n.rlike(SYNC_NAMES) | k.isin(SYNC_TYPES), "sync")]
    return F.coalesce(*tests, F.when(F.lower(n).rlike("eyetracker|tobii"), "tobii"), F.lit("other"))


def seat_of(text: Column) -> Column:
    """``P1`` to ``P4`` from the first seat token in the text, whatever its case; null if it has none."""
    n = F.regexp_extract(F.lower(F.trim(text)), r"(?:^|[^a-z0-9])(?:p|participant|tablet)[_\- ]?([1-4])(?:$|[^a-z0-9])", 1)
    return F.when(n != "", F.concat(F.lit("P"), n))


def entity(path: Column, key: str, value: str = "[A-Za-z0-9]+") -> Column:
    """The value of ``key-value`` in a file name; null if it has none."""
    v = F.regexp_extract(path, rf"(?:^|[_/]){key}-({value})", 1)
    return F.when(v != "", v)


def session_signature(name: Column) -> Column:
    """(date, group, run) from names that spell them in several ways, numbers padded to two digits."""
    number = lambda p: F.regexp_extract(F.lower(name), p, 1)
    pad = lambda n, prefix: F.when(n != "", F.concat(F.lit(prefix), F.lpad(n, 2, "0")))
    date = F.regexp_replace(F.regexp_extract(name, r"(20\d\d-?\d\d-?\d\d)", 1), "-", "")
    return F.struct(F.when(date != "", date).alias("date"), pad(number(r"(?:group|grp|gpr)[-_]?0*(\d+)"), "grp-").alias("group"), pad(number(r"run[-_]?0*(\d+)"), "run").alias("run"))


#: The device names that a label may have inside.
DEVICE_NAMES = [
    r"(jabra[-_]panacast[-_](?:20|50)(?:[-_]cam\d+)?[-_]vid)",
    r"(dpa[-_][a-z0-9]+(?:[-_][a-z0-9]+)?(?:[-_]aud)?)",
]


def canonical_key(label: Column) -> Column:
    """Stream and media labels folded to one key: the device's name if there is one, in lower case with ``_`` between words."""
    raw = F.regexp_replace(F.lower(F.trim(F.coalesce(label, F.lit("")))), "^ffmpeg_progress_", "")
    named = F.coalesce(*[F.when(F.regexp_extract(raw, p, 1) != "", F.regexp_extract(raw, p, 1)) for p in DEVICE_NAMES], F.regexp_replace(raw, "^acq-", ""))
    return F.regexp_replace(F.regexp_replace(named, "[^a-z0-9]+", "_"), "^_|_$", "")


def plain_name(name: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(name, r"\s+", " ")))


def item_score(text: Column, scale: dict[str, int], reverse: Column | bool = False) -> Column:
    """1 to 5 by the scale's words; reversed items 6 - v; null if unknown."""
    table = F.create_map(*[F.lit(x) for kv in scale.items() for x in kv])
    v = F.try_element_at(table, F.lower(F.trim(text)))
    return F.when(F.lit(reverse) if isinstance(reverse, bool) else reverse, 6 - v).otherwise(v)


def age_years(exact: Column, band: Column) -> Column:
    """A number cut to whole years, else of a band ``a-b`` the middle rounded down, of ``a+`` a; else null."""
    band = F.trim(band)
    low, high = (F.regexp_extract(band, r"^(\d+) ?- ?(\d+)$", k).try_cast("int") for k in (1, 2))
    plus = F.regexp_extract(band, r"^(\d+)\+$", 1).try_cast("int")
    return F.coalesce(finite(F.trim(exact)).try_cast("int"), F.floor((low + high) / 2).cast("int"), plus)


def first_match(text: Column, rules: list[tuple[str, str]], otherwise: str = "n/a") -> Column:
    """The value of the first substring found, for normalising free text (order matters)."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.coalesce(*[F.when(low.contains(s), v) for s, v in rules], F.lit(otherwise))


# --- maps of features ---------------------------------------------------------------------------


def flatten_maps(maps: list[Column], keys: Column) -> Column:
    """Values in order of ``keys``: the last map that has a key wins; missing or not finite is 0."""
    get = lambda k: F.coalesce(*[F.try_element_at(m, k) for m in reversed(maps)])
    return F.transform(keys, lambda k: F.coalesce(finite(get(k)), F.lit(0.0)))


def subset_map(m: Column, keys: list[str]) -> Column:
    return F.map_filter(m, lambda k, _: k.isin(*keys))


def one_hot(c: Column, values: list) -> Column:
    return F.array(*[F.coalesce((c == v).cast("int"), F.lit(0)) for v in values])


# --- geometry -----------------------------------------------------------------------------------


def to_pixels(x: Column, y: Column, width: float, height: float) -> Column:
    """Gaze as pixels: scaled by the frame if both are in [-0.2, 1.2], else taken as pixels."""
    unit = x.between(-0.2, 1.2) & y.between(-0.2, 1.2)
    return F.struct(F.when(unit, x * width).otherwise(x).alias("px"), F.when(unit, y * height).otherwise(y).alias("py"))


def dot(a: list[Column], b: list[Column]) -> Column:
    out = a[0] * b[0]
    for x, y in zip(a[1:], b[1:]):
        out = out + x * y
    return out


def rotate(v: list[Column], axis_angle: list[Column]) -> list[Column]:
    """A vector turned by an axis-angle vector (Rodrigues); no turn below 1e-12."""
    angle = F.sqrt(dot(axis_angle, axis_angle))
    k = [F.when(angle > 1e-12, a / angle).otherwise(0.0) for a in axis_angle]
    cross = [k[1] * v[2] - k[2] * v[1], k[2] * v[0] - k[0] * v[2], k[0] * v[1] - k[1] * v[0]]
    along = dot(k, v)
    return [x * F.cos(angle) + c * F.sin(angle) + u * along * (1 - F.cos(angle)) for x, c, u in zip(v, cross, k)]


def hit_plane(origin: list[Column], direction: list[Column]) -> Column:
    """Where a ray meets z = 0; null if it is parallel to it (1e-9) or meets it behind its origin."""
    s = F.when(F.abs(direction[2]) > 1e-9, -origin[2] / direction[2])
    return F.when(s > 0, F.struct((origin[0] + s * direction[0]).alias("wx"), (origin[1] + s * direction[1]).alias("wy")))


# --- soft labels --------------------------------------------------------------------------------


def normal_cdf(z: Column) -> Column:
    """Standard normal distribution function, by a rational approximation (error below 8e-8)."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    # The coefficients of the approximation.
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    upper = F.exp(-z * z / 2) / math.sqrt(2 * math.pi) * poly
    return F.when(z >= 0, 1 - upper).otherwise(upper)


def soft_label(mu: Column, sigma: Column, t1, t2, temperature=1.0) -> Column:
    """Mass of N(mu, max(sigma * temperature, 1e-4)) below t1, between, above t2; adds up to 1."""
    s = F.greatest(sigma * temperature, F.lit(1e-4))
    low, up = normal_cdf((F.lit(t1) - mu) / s), normal_cdf((F.lit(t2) - mu) / s)
    parts = [low, F.greatest(up - low, F.lit(0.0)), 1 - up]
    total = parts[0] + parts[1] + parts[2]
    return F.array(*[p / total for p in parts])


def temperature(sigma: Column, reference: float, largest: float) -> Column:
    return F.least(F.greatest(1 + (sigma - reference) / largest, F.lit(1.0)), F.lit(2.5))


def decay_weight(t: Column, times: Column, rate: float) -> Column:
    """exp(-rate * distance to the nearest time); 0 without one."""
    near = F.array_min(F.transform(times, lambda x: F.abs(t - x)))
    return F.coalesce(F.exp(-rate * near), F.lit(0.0))


def ordinal_targets(label: Column, classes: int = 9, sigma: float | None = None) -> Column:
    """P(Y > k) for k = 1 .. classes - 1: a step, or smoothed by a normal curve of width sigma."""
    ks = F.sequence(F.lit(1), F.lit(classes - 1))
    return F.transform(ks, lambda k: (label > k).cast("double") if not sigma else 1 - normal_cdf((k + 0.5 - label) / sigma))


def rescale(c: Column, mean: Column, sd: Column, to_mean: float = 6.22, to_sd: float = 1.85, low: float = 1.0, high: float = 9.0) -> Column:
    """Moved to another mean and spread and clipped; null if the spread is below 1e-6."""
    return F.when(sd >= 1e-6, F.least(F.greatest((c - mean) / sd * to_sd + to_mean, F.lit(low)), F.lit(high)))


# --- skeletons ----------------------------------------------------------------------------------


def gesture_flags(joint: dict[str, list[Column]], confidence: dict[str, Column], least: float, near_head: float, near_chest: float, reach: float) -> dict[str, Column]:
    """Hand at head (nose), hand at chest (middle of the hips), arm stretched, for each side, and both hands at the head.

    An arm counts if its shoulder, elbow and wrist are all there and sure. Without a nose or a
    middle of the hips nothing is near them; an arm without length is not stretched.
    """
    far = lambda a, b: F.sqrt(dot([x - y for x, y in zip(joint[a], joint[b])], [x - y for x, y in zip(joint[a], joint[b])]))
    out: dict[str, Column] = {}
    for side in ("left", "right"):
        arm = [f"{side}_{p}" for p in ("shoulder", "elbow", "wrist")]
        sure = F.coalesce(F.least(*[F.when(joint[n][0].isNotNull() & joint[n][1].isNotNull() & joint[n][2].isNotNull(), F.coalesce(confidence[n], F.lit(0.0))).otherwise(-1.0) for n in arm]) >= least, F.lit(False))
        length = far(arm[0], arm[1]) + far(arm[1], arm[2])
        out[f"{side}_head"] = sure & F.coalesce(far(arm[2], "nose") <= near_head, F.lit(False))
        out[f"{side}_chest"] = sure & F.coalesce(far(arm[2], "mid_hip") <= near_chest, F.lit(False))
        out[f"{side}_stretched"] = sure & F.coalesce((length > 1e-6) & (far(arm[0], arm[2]) >= reach * length), F.lit(False))
    out["both_head"] = out["left_head"] & out["right_head"]
    return out


def joint_ok(confidence: Column, error: Column, cameras: Column, least: float, most_error: float, least_cameras: int) -> Column:
    """Whether a 3-D joint passes: confident, seen by enough cameras, error unknown (< 0) or small."""
    return (confidence >= least) & ((error < 0) | (error <= most_error)) & (cameras >= least_cameras)

"""Queries against their SQL on small tables of odd events: plateaus, short tasks, few or equal samples, sums at a threshold."""

from __future__ import annotations

import datetime
import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from cohorta.operators import soft_labels as soft
from cohorta.plans import registry
from tests.oracle import TABLES, differences

DAY = 86_400_000_000
START = datetime.datetime(2024, 1, 1)


def tables(folder, events) -> str:
    """The smallest tables with these events: (day, user_id, event_type, value) each."""
    os.makedirs(folder, exist_ok=True)
    for t in TABLES:
        if t != "events":
            os.symlink(f"/root/testdata/sf0.001/{t}.parquet", f"{folder}/{t}.parquet")
    cols = {
        "event_id": pa.array([e[4] if len(e) > 4 else i for i, e in enumerate(events)], pa.int64()),
        "ts": pa.array([START + datetime.timedelta(microseconds=round(e[0] * DAY)) for e in events], pa.timestamp("us")),
        "user_id": pa.array([e[1] for e in events], pa.int64()), "event_type": pa.array([e[2] for e in events]), "value": pa.array([e[3] for e in events], pa.float64()), "props": pa.array(['{"k": 1}'] * len(events)),
    }
    pq.write_table(pa.table(cols), f"{folder}/events.parquet")
    return str(folder)


def same(spark, name, sf) -> int:
    extra, missing, n = differences(spark, registry.QUERIES[name], registry.ORACLE_SQL[name], sf)
    assert not extra and not missing, (list(extra)[:3], list(missing)[:3], n)
    return n


@pytest.mark.parametrize("hours", [6, 11.99, 12.5, 23.9, 30])
def test_a_task_short_of_a_window(spark, tmp_path, hours):
    events = [(0, 0, "view", 1.0), (30, 0, "view", 1.0), (13, 0, "signup", 1.0), *[(13 + k / 50, 0, "click", 1.0) for k in range(1, 9)], (13 + hours / 24, 0, "purchase", 1.0)]
    events.sort()
    n = same(spark, "task_anchored_windows", tables(tmp_path / "t", events))
    assert n == (hours > 12)


def test_plateaus_are_no_peaks(spark, tmp_path):
    heights = [10, 60, 60, 10, 90, 10, 80, 80, 80, 10, 70, 30, 30, 75, 5]
    events = [(k / 20, 0, "view", float(h)) for k, h in enumerate(heights)]
    assert same(spark, "peak_prominences", tables(tmp_path / "t", events)) == 3


def test_segments_of_few_and_of_equal_samples(spark, tmp_path):
    """25 and 39 samples are two segments each; of samples at one time with one value there is no slope."""
    events = [(d / 40 * 30, u, "view", float(d * 7 % 11)) for u, n in ((0, 25), (1, 39), (2, 40), (3, 1), (5, 20)) for d in range(n)]
    events += [(3.3, 6, "view", 0.1)] * 17 + [(k // 9, 7, "view", 0.7) for k in range(36)]
    events.sort()
    sf = tables(tmp_path / "t", events)
    assert same(spark, "piecewise_clock_fit", sf) == 2 + 2 + 2 + 1 + 1 + 1 + 2
    assert spark.read.parquet(f"{sf}/events.parquet").where("user_id = 6").count() == 17


def test_equal_reports_do_not_agree(spark):
    """Partial sums of equal values, as of many tasks, leave no spread that a correlation could rest on."""
    rows = [(s, 0, float(d % 7), 1.0 + d * 5 % 7, None) for s in range(60) for d in range(6)] + [(s, 1, 3.0, 1.0 + s * 0.37 % 7, None) for s in range(60)]
    df = spark.createDataFrame(rows, "session long, seat int, t double, v double, w double").withColumn("task", soft.F.lit("T0")).repartition(4)
    kept = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = soft.agreement(df, ["session", "task"], "seat", "t", ["v"], 8.0, soft.F.lit(0.3)).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", kept)
    assert len(got) == 120 and {r["rho"] for r in got} == {0.05}


#: Added up from the left these are above 60 (below it), from the right they are 60.
ABOVE, BELOW = (28.37, 27.53, 4.1), (18.88, 22.58, 18.54)


@pytest.mark.parametrize("name, column", [("dominant_speaker", "speaking"), ("overlap_share", "overlap")])
def test_sums_do_not_depend_on_the_files(spark, tmp_path, name, column):
    events = [(1 + k / 10, u, "view", x, 10 * u + k) for u, values in ((0, ABOVE), (4, BELOW), (5, (30.0,)), (8, ABOVE), (9, (30.0,))) for k, x in enumerate(values)]
    events.sort()
    sf, turned = tables(tmp_path / "a", events), tables(tmp_path / "b", events[::-1])
    assert same(spark, name, sf)
    rows = lambda path: sorted(tuple(r) for r in registry.QUERIES[name](spark, path).collect())
    assert rows(sf) == rows(turned)
    found = [r[column] for r in registry.QUERIES[name](spark, turned).orderBy("session").collect()]
    assert found[0] is True if column == "speaking" else found == [0.0, 1.0, 0.0]

"""What substring deduplication leaves on disk between its steps."""

from __future__ import annotations

import random
import time

from cohorta.llm import substring_dedup


def test_no_step_keeps_the_shuffle_files_of_earlier_ones(spark, monkeypatch):
    """When a step begins, the shuffles of the steps before it go, and later copies carry no anchor."""
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    passages = [" ".join(rng.choice(words) for _ in range(40)) for _ in range(12)]
    rows = [(i, " ".join(rng.choice(passages) if rng.random() < 0.4 else rng.choice(words) for _ in range(30))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").localCheckpoint()
    jvm = spark.sparkContext._jvm
    tracker = jvm.org.apache.spark.SparkEnv.get().mapOutputTracker()
    shuffles = lambda: {int(x) for x in tracker.shuffleStatuses().keySet().mkString(",").split(",") if x}
    write, kept, judged, base = substring_dedup.staged, {}, [], shuffles()

    def staged(frame, name):
        end = time.time() + 5
        while shuffles() - base and time.time() < end and name in ("firsts", "known", "judged"):
            time.sleep(0.1)
        kept[name] = len(shuffles() - base)
        out = write(frame, name)
        if name == "judged":
            judged.extend(out.where("later").select("v", "spans").distinct().collect())
        return out

    monkeypatch.setattr(substring_dedup, "staged", staged)
    found = substring_dedup.remove_repeats(df).collect()
    assert {i: bytes(k) for i, _, _, k in found}.keys() == {i for i, _ in rows}
    assert [kept[x] for x in ("firsts", "known", "judged")] == [0, 0, 0], kept
    assert [tuple(r) for r in judged] == [(None, None)]

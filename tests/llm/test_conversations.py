"""Conversation repair against brute force and SQL; awkward tables; long conversations."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohorta.llm import conversations as conv
from cohorta.llm import queries
from tests.oracle import differences

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string"


def repaired(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("Lost_", F.lit(1)).withColumn("cost", F.lit("x"))
    return [tuple(r) for r in conv.repair_conversations(conv.damaged(df)).collect()]


def key(r):
    return (r[0] is not None, r[0] or 0)


def test_against_sql_and_brute_force(spark):
    extra, missing, n = differences(spark, queries.QUERIES["op13_conversation_repair"], queries.ORACLE_SQL["op13_conversation_repair"], SF)
    assert not extra and not missing and n, (list(extra)[:3], list(missing)[:3])
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = [tuple(r) for r in conv.op13_conversation_repair(spark, SF).collect()]
    assert sorted(got) == sorted(conv.brute_force(rows))


def test_random_conversations(spark):
    rng = random.Random(13)
    roles, texts = ["user", "user", "assistant", "assistant", "system", "tool", "", None, "agent"], ["a.", "b?", "c", "", " \t", None, "d! \n", "é.", " "]
    rows = [(rng.choice([None, *range(400)]), rng.choice([None, *range(12)]), rng.choice(roles), rng.choice(texts)) for _ in range(3000)]
    rows += rows[:200]
    assert sorted(repaired(spark, rows), key=key) == sorted(conv.brute_force(rows), key=key)


def test_grammar_and_costs():
    def audit(*turns):
        at, seen = conv.Repair(), set()
        for role, text in turns:
            at.row(role, text, conv.fault(role, text, (role, text) in seen))
            seen.add((role, text))
        return at.result()[:2]

    assert audit() == (0, "")
    assert audit(("system", "x."), ("user", "x."), ("assistant", "y.")) == (0, "KKK")
    assert audit(("system", "x.")) == (2, "D")
    assert audit(("user", "x."), ("user", "y.")) == (1, "KR")
    assert audit(("user", "x."), ("user", "y."), ("user", "z."), ("assistant", "w.")) == (1, "KRKK")
    assert audit(("assistant", "x."), ("system", "y.")) == (2, "RR")
    assert audit(("user", "x."), ("assistant", "cut")) == (4, "DD")
    assert audit(("user", "x."), ("assistant", "y."), ("user", "z."), ("assistant", " ")) == (4, "KKDD")
    assert conv.fault("user", "\xa0", False) == "truncated" and conv.fault("user", " \t\v", True) == "blank"
    with pytest.raises(ValueError):
        conv.Repair.EDITS.index("III")


def test_empty_table_and_lost_conversations(spark):
    assert repaired(spark, []) == []
    gone = next(c for c in range(1000) if conv.zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert repaired(spark, [(gone, 0, "user", "x.")]) == [(gone, 0, 0, 0, 0, 0, 0, "", conv.hashlib.sha256(b"").hexdigest())]


def test_keys_of_other_types_and_long_conversations(spark):
    rows = [("one", t, "user" if t % 2 == 0 else "assistant", f"turn {t}." + "x" * (200_000 * (t == 7)) + ".") for t in range(6000)]
    schema = T.StructType().add("conv_id", "string").add("turn", "integer").add("role", "string").add("text", "string")
    got = conv.repair_conversations(conv.damaged(spark.createDataFrame(rows, schema))).collect()
    assert [tuple(r) for r in got] == conv.brute_force(rows)

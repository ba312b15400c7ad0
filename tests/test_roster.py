"""Names: block ratios against all pairs, every tier, and rosters by hand."""

from __future__ import annotations

import difflib
import random

import pytest

from cohorta.operators import roster


def words(seed, n):
    rng = random.Random(seed)
    first, last = ["Anna", "Annika", "Bo", "Grace", "Mathias", "Søren", "RJ", "Ann a"], ["Hansen", "Hanson", "Møller Bruhn", "Li", "Ceesay-Hanses", "Martz", ""]
    out = {f"{rng.choice(first)} {rng.choice(last)}" for _ in range(n)}
    for name in sorted(out):
        if rng.random() < 0.5 and name:
            k = rng.randrange(len(name))
            out.add(name[:k] + rng.choice("aeßn ") + name[k + 1 :])
    return sorted(out)


@pytest.mark.parametrize("cutoff", [0.4, 0.6, 0.85, 1.0])
def test_all_pairs_at_the_cutoff(spark, cutoff):
    a, b = words(1, 30), words(2, 30)
    plain = lambda x: " ".join(x.lower().split())
    left, right = sorted({plain(x) for x in a}), sorted({plain(x) for x in b})
    got = {(r["a"], r["b"]): r["ratio"] for r in roster.close_pairs(spark.createDataFrame([(x,) for x in left], "a string"), spark.createDataFrame([(x,) for x in right], "b string"), cutoff).collect()}
    want = {(x, y): difflib.SequenceMatcher(None, y, x).ratio() for x in left for y in right}
    assert got == {k: v for k, v in want.items() if v >= cutoff} and got
    rows = roster.closest(spark.createDataFrame([(x,) for x in a] + [(None,), ("",)], "n string"), spark.createDataFrame([(x,) for x in b], "m string"), "n", "m", cutoff).collect()
    assert len(rows) == len(a) + 2
    for r in rows:
        best = difflib.get_close_matches(plain(r["n"] or ""), right, n=1, cutoff=cutoff)
        if best:
            assert plain(r["match"]) == best[0] and r["score"] == pytest.approx(difflib.SequenceMatcher(None, plain(r["n"] or ""), best[0]).ratio())
        else:
            assert r["match"] is None and r["score"] is None


def test_tiers(spark):
    stored = spark.createDataFrame([(1, "Jarle Schnoor Østvedt"), (2, "Mathias Møller Bruhn"), (3, "Christian Buch Rønborg"), (4, "Anna Li"), (5, "Anna Mae Li"), (6, "José Núñez"), (7, "Harsha Vardhan"), (8, "ANNA LI")], "id int, full string")
    aliases = spark.createDataFrame([("RJ", "Jarle Schnoor Østvedt"), ("nobody", "Not Stored")], "alias string, full string")
    asked = ["mathias møller bruhn", "rj", "Mathias Bruhn", "anna li", "Anna X Li", "Christian Buch RÃ¸nborg", "jose nunez", "Vardhan", "Anna", "nobody", "Buch", "", None, "Xé Anna"]
    rows = roster.tiers(spark.createDataFrame([(x,) for x in asked] * 2, "name string"), stored, aliases, "name", "id", "full").collect()
    got = {r["name"]: (r["match"], r["tier"]) for r in rows}
    assert len(rows) == 2 * len(asked)
    assert got == {
        "mathias møller bruhn": (2, "exact"), "rj": (1, "alias"), "Mathias Bruhn": (2, "ends"), "anna li": (8, "exact"), "Anna X Li": (5, "ends"), "Christian Buch RÃ¸nborg": (3, "tokens"), "jose nunez": (6, "exact"),
        "Vardhan": (7, "tokens"), "Anna": (None, None), "nobody": (None, None), "Buch": (3, "tokens"), "": (None, None), None: (None, None), "Xé Anna": (None, None),
    }


def test_roster(spark):
    sessions = spark.createDataFrame([(2, "Bo Hansen; Grace Li"), (1, "Anna Martz;; Bo Hansen "), (3, None), (4, " ; Carl Moe")], "o int, names string")
    people = roster.participants(sessions, "o", "names")
    assert sorted((r["sub_id"], r["session_name"]) for r in people.collect()) == [("sub-001", "Anna Martz"), ("sub-002", "Bo Hansen"), ("sub-003", "Grace Li"), ("sub-004", "Carl Moe")]
    said = spark.createDataFrame([(1, "anna martz", 30), (2, "Bo Hanson", 31), (3, "Xerxes", 32), (4, "bo  hansen", 33), (5, None, 34)], "row int, name string, age int")
    review = roster.roster_matches(people, said, "row", "name")
    got = sorted(tuple(r) for r in review.drop("row").collect())
    assert got == [
        ("UNMATCHED", "", "", 0.0, "unmatched"), ("UNMATCHED", "", "Xerxes", 0.0, "unmatched"), ("sub-001", "Anna Martz", "anna martz", 1.0, "matched"), ("sub-002", "Bo Hansen", "Bo Hanson", 0.889, "matched"),
        ("sub-002", "Bo Hansen", "bo  hansen", 1.0, "matched"), ("sub-003", "Grace Li", "", 0.0, "no_questionnaire"), ("sub-004", "Carl Moe", "", 0.0, "no_questionnaire"),
    ]
    rows = roster.roster(people, review, said, "row", ["age"]).collect()
    assert {r["participant_id"]: r["age"] for r in rows} == {"sub-001": 30, "sub-002": 33, "sub-003": None, "sub-004": None}  # the later match wins
    nobody = roster.participants(spark.createDataFrame([], "o int, names string"), "o", "names")
    assert nobody.count() == 0 and roster.roster_matches(nobody, said, "row", "name").where("status = 'unmatched'").count() == 5

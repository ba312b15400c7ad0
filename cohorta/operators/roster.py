"""Names: matching by longest common blocks, a cascade of tiers, and the roster of all participants."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohorta.functions.scalars import plain_name
from cohorta.operators import ranks

#: Combining marks of the Unicode blocks for them.
MARKS = r"[̀-ͯ᪰-᫿᷀-᷿⃐-⃿︠-︯]"


@F.pandas_udf(T.StringType())
def _decomposed(name: pd.Series) -> pd.Series:
    return name.str.normalize("NFKD")


def bare_name(name: Column) -> Column:
    """Lower case without combining marks and outer blanks; null is empty."""
    ascii_only = name.rlike(r"^[\x00-\x7f]*$")
    return F.trim(F.lower(F.regexp_replace(F.when(ascii_only, name).otherwise(_decomposed(name)), MARKS, ""))) if name is not None else F.lit("")


@F.pandas_udf(T.DoubleType())
def block_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the letters in common blocks over all letters: the longest block, then the same left and right of it. Not symmetric."""
    return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype=float)


def _letters(c: str) -> Column:
    """Each letter of a name with the number of its occurrence, so that shared ones can be counted as a set."""
    chars = F.filter(F.split(c, ""), lambda x: x != "")
    at = F.transform(chars, lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    return F.transform(at, lambda p: F.concat(p["x"], F.size(F.filter(at, lambda q: (q["x"] == p["x"]) & (q["i"] < p["i"]))).cast("string")))


def close_pairs(left: DataFrame, right: DataFrame, cutoff: float) -> DataFrame:
    """a, b, ratio of all pairs of names (columns a and b, each once) whose block ratio (of b against a) reaches the cutoff.

    Common blocks hold at most the letters that both have, so a pair at the cutoff shares cutoff (m + n) / 2 letters of m and n.
    Of a name's letters, rarest first, one of the first m - least + 1 is then shared; pairs meet on such a letter and the
    lengths that can still reach the cutoff, and are measured only if enough letters are shared.
    """
    l, r = left.withColumn("_x", _letters("a")), right.withColumn("_y", _letters("b"))  # noqa: E741
    count = r.select(F.explode("_y").alias("letter")).groupBy("letter").agg(F.count("*").alias("n"))  # one row a letter and place

    def rare(df: DataFrame, name: str, letters: str) -> DataFrame:
        m = F.size(letters)
        needed = F.ceil(cutoff * m / (2 - cutoff) - F.lit(1e-9))  # with the shortest name that can reach the cutoff
        each = df.select(name, letters, m.alias("_m"), needed.alias("_needed"), F.explode(letters).alias("letter")).join(F.broadcast(count), "letter", "left")
        place = F.row_number().over(Window.partitionBy(name).orderBy(F.coalesce("n", F.lit(0)), "letter"))
        return each.withColumn("_k", place).where(F.col("_k") <= F.col("_m") - F.col("_needed") + 1).select(name, letters, "letter")

    both = rare(l, "a", "_x").join(rare(r, "b", "_y"), "letter")
    m, n = F.size("_x"), F.size("_y")
    shared = both.where(2 * F.least(m, n) >= cutoff * (m + n) - F.lit(1e-9)).select("a", "b", "_x", "_y").dropDuplicates(["a", "b"])
    shared = shared.where(2 * F.size(F.array_intersect("_x", "_y")) >= cutoff * (F.size("_x") + F.size("_y")) - F.lit(1e-9))
    return shared.select("a", "b", block_ratio("b", "a").alias("ratio")).where(F.col("ratio") >= cutoff)


def closest(left: DataFrame, right: DataFrame, a: str, b: str, cutoff: float = 0.6) -> DataFrame:
    """Left rows with ``match`` (a right name) and ``score``: the right name of highest block ratio, of equal ones the greatest; null below the cutoff.

    Names are compared in lower case with single blanks; of right names that are then equal the least is taken.
    The score is the ratio the other way round.
    """
    l, r = left.withColumn("_a", F.coalesce(plain_name(F.col(a)), F.lit(""))), right.select(F.col(b).alias("_name"), plain_name(F.col(b)).alias("_b")).where("_b is not null")  # noqa: E741
    stored = r.groupBy("_b").agg(F.min("_name").alias("match"))
    best = close_pairs(l.select(F.col("_a").alias("a")).distinct(), stored.select(F.col("_b").alias("b")), cutoff).groupBy("a").agg(F.max(F.struct("ratio", "b")).alias("_best"))
    found = best.join(stored, F.col("_best.b") == F.col("_b")).select(F.col("a").alias("_a"), "match", block_ratio("a", F.col("_best.b")).alias("score"))
    return l.join(found, "_a", "left").drop("_a")


def tiers(names: DataFrame, stored: DataFrame, aliases: DataFrame, name: str, key: str, full: str) -> DataFrame:
    """``names`` with ``match`` (a ``key`` of ``stored``) and ``tier``: exact, alias, ends, tokens, or null for none.

    Each tier sees what the ones before have left: the bare name; its alias (columns alias and full, both as written); first and
    last token, of several the least key; all its ASCII tokens of four letters or more within exactly one stored name.
    Equal stored names count once, with the greatest key.
    """
    known = stored.select(bare_name(F.col(full)).alias("_full"), F.col(key).alias("_key")).groupBy("_full").agg(F.max("_key").alias("_key"))
    asked = names.select(name).where(F.col(name).isNotNull() & (F.col(name) != "")).distinct().withColumn("_bare", bare_name(F.col(name)))
    found = asked.join(known, F.col("_bare") == F.col("_full")).select(name, F.col("_key").alias("match"), F.lit("exact").alias("tier"))
    left = asked.join(found.select(name), name, "left_anti")
    other = aliases.select(bare_name(F.col("alias")).alias("_bare"), bare_name(F.col("full")).alias("_full")).distinct()
    by_alias = left.join(other, "_bare").join(known, "_full").groupBy(name).agg(F.min("_key").alias("match")).withColumn("tier", F.lit("alias"))
    left = left.join(by_alias.select(name), name, "left_anti")
    parts = lambda c: F.filter(F.split(c, r"\s+"), lambda t: t != "")
    ends = lambda df, c: df.withColumn("_t", parts(c)).where(F.size("_t") >= 2).withColumn("_first", F.get("_t", 0)).withColumn("_last", F.element_at("_t", -1))
    by_ends = ends(left, "_bare").join(ends(known, "_full").select("_first", "_last", "_key"), ["_first", "_last"]).groupBy(name).agg(F.min("_key").alias("match")).withColumn("tier", F.lit("ends"))
    left = left.join(by_ends.select(name), name, "left_anti")
    tokens = F.transform(F.filter(parts(name), lambda t: t.rlike(r"^[\x00-\x7f]*$") & (F.length(t) >= 4)), F.lower)
    asked4 = left.withColumn("_tokens", tokens).where(F.size("_tokens") > 0).withColumn("_four", F.substring(F.get("_tokens", 0), 1, 4))
    fours = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("_full") - 3), lambda i: F.substring("_full", i, F.lit(4))))
    held = known.where(F.length("_full") >= 4).select("_full", "_key", F.explode(fours).alias("_four"))
    inside = asked4.join(held, "_four").where(F.forall("_tokens", lambda t: F.contains(F.col("_full"), t)))
    by_tokens = inside.groupBy(name).agg(F.count("*").alias("_n"), F.min("_key").alias("match")).where("_n = 1").select(name, "match").withColumn("tier", F.lit("tokens"))
    return names.join(found.unionByName(by_alias).unionByName(by_ends).unionByName(by_tokens), name, "left")


def participants(sessions: DataFrame, order: str, listed: str) -> DataFrame:
    """sub_id and session_name of every name in the sessions' lists (separated by ``;``), numbered as first seen.

    Sessions go by a number, ``order``; blank entries and sessions without a list name nobody.
    """
    each = sessions.select(F.col(order).alias("_o"), F.posexplode(F.split(listed, ";")).alias("_p", "n")).withColumn("session_name", F.trim("n")).where("session_name != ''")
    first = each.groupBy("session_name").agg(F.min(F.struct("_o", "_p")).alias("_s")).select("session_name", F.col("_s._o").alias("_o"), F.col("_s._p").alias("_p"))
    numbered = ranks.row_numbers(first, ["_o", "_p", "session_name"], "_n")
    return numbered.select(F.format_string("sub-%03d", F.col("_n").cast("long")).alias("sub_id"), "session_name", F.col("_n").alias("number"))


def roster_matches(people: DataFrame, respondents: DataFrame, order: str, name: str, cutoff: float = 0.6) -> DataFrame:
    """The review table: each respondent with the participant of closest name, and the participants nobody was matched to.

    sub_id (UNMATCHED without one), session_name, questionnaire_name, match_score, status (matched, unmatched, no_questionnaire), and ``order`` of the respondent.
    """
    asked = respondents.select(F.col(order).alias("_o"), F.trim(F.coalesce(F.col(name), F.lit(""))).alias("questionnaire_name"))
    hit = closest(asked, people, "questionnaire_name", "session_name", cutoff).join(people.select(F.col("session_name").alias("match"), "sub_id"), "match", "left")
    rows = hit.select(F.coalesce("sub_id", F.lit("UNMATCHED")).alias("sub_id"), F.coalesce("match", F.lit("")).alias("session_name"), "questionnaire_name", F.round(F.coalesce("score", F.lit(0.0)), 3).alias("match_score"), F.when(F.col("match").isNull(), "unmatched").otherwise("matched").alias("status"), F.col("_o").alias(order))
    alone = people.join(rows.where("status = 'matched'").select("session_name").distinct(), "session_name", "left_anti")
    return rows.unionByName(alone.select("sub_id", "session_name", F.lit("").alias("questionnaire_name"), F.lit(0.0).alias("match_score"), F.lit("no_questionnaire").alias("status"), F.lit(None).cast(dict(respondents.dtypes)[order]).alias(order)))


def roster(people: DataFrame, review: DataFrame, respondents: DataFrame, order: str, values: list[str]) -> DataFrame:
    """participant_id, session_name and the values of the respondent matched to each participant; of several the last one's, of none null."""
    last = review.where("status = 'matched'").groupBy("session_name").agg(F.max(order).alias(order))
    mine = last.join(respondents.select(order, *values), order).select("session_name", *values)
    return people.select(F.col("sub_id").alias("participant_id"), "session_name").join(mine, "session_name", "left").select("participant_id", "session_name", *values)

"""Queries of names and rosters: nations' suppliers as sessions, customers as respondents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohorta.operators import roster as names
from cohorta.plans.base import table

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


_PEOPLE = """s AS (SELECT l_orderkey AS o, string_agg(p_name || CASE WHEN l_quantity > 25 THEN ' ' ELSE '' END, ';' ORDER BY l_linenumber, p_name || CASE WHEN l_quantity > 25 THEN ' ' ELSE '' END) AS names FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY l_orderkey),
e AS (SELECT o, i, trim(string_split(names, ';')[i]) AS session_name FROM s, unnest(range(1, len(string_split(names, ';')) + 1)) u(i)),
f AS (SELECT session_name, min((o, i)) AS seen FROM e WHERE session_name <> '' GROUP BY session_name),
p AS (SELECT printf('sub-%03d', row_number() OVER (ORDER BY seen, session_name)) AS sub_id, session_name FROM f)"""


def _sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("p_partkey") == F.col("l_partkey"))
    each = named.select("l_orderkey", "l_linenumber", F.concat("p_name", F.when(F.col("l_quantity") > 25, " ").otherwise("")).alias("n"))
    return each.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "n"))).alias("v")).select("l_orderkey", F.array_join("v.n", ";").alias("names"))  # an order has few lines


def _respondents(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    said = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.upper("p_name"), F.lit("  "))).when(F.col("p_partkey") % 3 == 1, F.concat("p_name", F.lit(" jr"))).otherwise(F.regexp_replace("p_name", " ", "   "))
    return p.select(F.col("p_partkey").alias("row"), said.alias("name"), F.col("p_size").cast("long").alias("age"))


@query("WITH " + _PEOPLE + """, q AS (SELECT p_partkey AS row, trim(CASE p_partkey % 3 WHEN 0 THEN upper(p_name) || '  ' WHEN 1 THEN p_name || ' jr' ELSE replace(p_name, ' ', '   ') END) AS name FROM part),
m AS (SELECT q.row, q.name, p.sub_id, p.session_name FROM q LEFT JOIN p ON lower(p.session_name) = lower(regexp_replace(q.name, '\\s+', ' ', 'g')))
SELECT coalesce(sub_id, 'UNMATCHED') AS sub_id, coalesce(session_name, '') AS session_name, name AS questionnaire_name, CAST(CASE WHEN sub_id IS NULL THEN 0 ELSE 1 END AS DOUBLE) AS match_score, CASE WHEN sub_id IS NULL THEN 'unmatched' ELSE 'matched' END AS status, row FROM m
UNION ALL SELECT sub_id, session_name, '', CAST(0 AS DOUBLE), 'no_questionnaire', NULL FROM p WHERE session_name NOT IN (SELECT session_name FROM m WHERE session_name IS NOT NULL)""")
def roster_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts in orders as participants, spelled otherwise as respondents; SQL can express equal names only, so the cutoff is 1."""
    people = names.participants(_sessions(spark, sf_dir), "l_orderkey", "names")
    return names.roster_matches(people, _respondents(spark, sf_dir), "row", "name", 1.0)


@query("WITH " + _PEOPLE + """, m AS (SELECT session_name, max(p_partkey) AS last FROM p JOIN part ON lower(session_name) = lower(p_name) WHERE p_partkey % 3 <> 1 GROUP BY session_name)
SELECT sub_id AS participant_id, p.session_name, CAST(p_size AS BIGINT) AS age FROM p LEFT JOIN m USING (session_name) LEFT JOIN part ON p_partkey = last""")
def roster_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    people, said = names.participants(_sessions(spark, sf_dir), "l_orderkey", "names"), _respondents(spark, sf_dir)
    return names.roster(people, names.roster_matches(people, said, "row", "name", 1.0), said, "row", ["age"])


@query()
def roster_review_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same at the usual cutoff, where ``jr`` finds its name; tests hold the ratio against all pairs."""
    people = names.participants(_sessions(spark, sf_dir), "l_orderkey", "names")
    return names.roster_matches(people, _respondents(spark, sf_dir), "row", "name", 0.6)


@query("""WITH n AS (SELECT DISTINCT p_name AS whole FROM part), k AS (SELECT whole, (SELECT min(p_partkey) FROM part WHERE p_name = whole) AS key FROM n),
a AS (SELECT DISTINCT CASE c_custkey % 4 WHEN 0 THEN upper(p_name) WHEN 1 THEN split_part(p_name, ' ', 1) || ' middle ' || split_part(p_name, ' ', 2) WHEN 2 THEN 'nick ' || p_name ELSE 'zzé ' || p_name END AS name, c_custkey % 4 AS way, p_name AS whole FROM customer JOIN part ON p_partkey = c_custkey),
c AS (SELECT a.name, a.way, a.whole, count(*) AS n, min(k.key) AS key FROM a JOIN k ON CASE WHEN way = 3 THEN list_bool_and(list_transform(list_filter(string_split(a.whole, ' '), lambda t: len(t) >= 4), lambda t: contains(k.whole, t))) AND len(list_filter(string_split(a.whole, ' '), lambda t: len(t) >= 4)) > 0 ELSE k.whole = a.whole END GROUP BY ALL)
SELECT a.name, CASE WHEN n = 1 THEN key END AS match, CASE WHEN n = 1 THEN CASE a.way WHEN 0 THEN 'exact' WHEN 1 THEN 'ends' WHEN 2 THEN 'alias' ELSE 'tokens' END END AS tier FROM a LEFT JOIN c USING (name, way, whole)""")
def name_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names as stored, customers' spellings of them: in capitals, with a middle name, by nickname, and with a mangled first token."""
    p, c = table(spark, sf_dir, "part"), table(spark, sf_dir, "customer")
    both = c.join(p, F.col("p_partkey") == F.col("c_custkey"))
    way, full = F.col("c_custkey") % 4, F.col("p_name")
    said = F.when(way == 0, F.upper(full)).when(way == 1, F.concat(F.substring_index(full, " ", 1), F.lit(" middle "), F.get(F.split(full, " "), 1))).when(way == 2, F.concat(F.lit("nick "), full)).otherwise(F.concat(F.lit("zzé "), full))
    asked = both.select(said.alias("name")).distinct()
    aliases = both.where(way == 2).select(said.alias("alias"), full.alias("full")).distinct()
    stored = p.groupBy(F.col("p_name").alias("full")).agg(F.min("p_partkey").alias("key"))
    return names.tiers(asked, stored, aliases, "name", "key", "full").select("name", "match", "tier")

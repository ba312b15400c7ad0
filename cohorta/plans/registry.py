"""All queries of the group-analytics operators by name, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cohorta.plans import checks, clocks, columns, context, dataset, evaluation, eyes, features, gaze, groups, joins, models, order, roster, scalars, sessions, soft_labels, splits, states, trials, waves, windows

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
for _part in (windows, joins, features, groups, clocks, evaluation, scalars, context, states, models, dataset, trials, waves, order, soft_labels, roster, splits, gaze, eyes, columns, sessions, checks):
    QUERIES |= _part.QUERIES
    ORACLE_SQL |= _part.ORACLE_SQL


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.rolling_features(spark, sf_dir)

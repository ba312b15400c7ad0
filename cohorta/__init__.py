"""Cohort and corpus analytics on Spark: DataFrame in, DataFrame out."""

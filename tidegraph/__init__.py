"""Reachability analytics on Spark: transition systems explored, checked and traced as DataFrames."""

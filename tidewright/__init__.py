"""Spec-driven profiling, cleaning, enrichment and KPI jobs on Spark DataFrames."""

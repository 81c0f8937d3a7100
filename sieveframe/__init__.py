"""Findings, call graphs and corpora on Spark: operators as functions from DataFrames to DataFrames."""

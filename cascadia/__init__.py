"""Influence analytics under the Independent Cascade model, on Spark DataFrames."""

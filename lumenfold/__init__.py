"""Lumenfold: a commerce analytics engine on Spark DataFrames."""

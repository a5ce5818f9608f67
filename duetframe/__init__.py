"""Preference-data engine on Spark DataFrames."""

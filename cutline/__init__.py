"""Requirement matching and historical cutoff analysis on Spark DataFrames."""

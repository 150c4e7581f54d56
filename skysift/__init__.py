"""Ranking by repeated judgment, sky cross-match and evaluation on Spark DataFrames."""

"""Tidewell: relational, time, text, vector and streaming operators on PySpark DataFrames."""

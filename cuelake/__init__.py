"""Timed-text analytics and corpus operators on PySpark DataFrames."""

"""Batch web-site auditing as Spark DataFrames."""

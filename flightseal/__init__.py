"""Telemetry-integrity analytics on Spark DataFrames."""

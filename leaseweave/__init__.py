"""Lease-contract analytics on Spark DataFrames."""

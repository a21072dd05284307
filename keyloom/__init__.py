"""Keyed, mergeable state tables on Spark: push, pull, scan, snapshot, reshard and sync with DataFrames."""

"""Ordered-ledger and time-series analytics on Spark."""

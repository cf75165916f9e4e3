"""Structured filters, keyset paging, change data capture, reconciliation and data-quality jobs on Spark DataFrames."""

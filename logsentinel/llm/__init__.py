"""Operators of a training-data pipeline: filters, near-duplicates, scoring, packing, media.

Every operator is a function from DataFrames to a DataFrame. Text kernels work on Arrow
batches inside tasks; Spark does the partitioning, joins, grouping and shuffles.
"""

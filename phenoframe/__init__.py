"""Satellite image time series as Spark DataFrames.

Operators take and return DataFrames and address columns by name. Row-local work is
expressed as Column functions (``phenoframe.functions``), work that moves rows as
DataFrame operators (``phenoframe.operators``), and whole preparation paths as
``phenoframe.plans``.
"""

__version__ = "0.1.0"

"""A Spark-first engine for media catalogues: predicates, views, joins, windows, planning and dense arrays."""

__version__ = "0.1.0"

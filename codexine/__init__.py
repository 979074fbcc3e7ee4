"""Statute analytics on Spark: text, joins, ranking, graphs, evaluation and planning over tables."""

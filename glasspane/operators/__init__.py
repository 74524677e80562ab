"""Relational operators: filters, joins, splits, aggregates, grids, curves."""

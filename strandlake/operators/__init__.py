"""Operators: indexes, joins, k-mer sketches, suffix arrays, read simulation."""

"""Reusable DataFrame operators: ordered groups, joins, rankings, sequences, scoring."""

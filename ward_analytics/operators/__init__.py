"""Relation-level operators: every one takes and returns DataFrames, for all patients at once."""

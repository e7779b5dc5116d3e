"""Operators: each takes and returns DataFrames, keeps doc_id and pos, and runs no job."""

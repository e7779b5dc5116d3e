"""Composed plans: the staged pipeline and the query catalogue."""

"""Training-data operators: deduplication, filtering, mixing, tokenising and formatting.

Nothing outside this subpackage imports it. ``queries.py`` registers its queries.
"""

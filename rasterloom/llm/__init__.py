"""Operators that prepare training data for language models, one module each.

Nothing outside this package imports it; ``queries.py`` holds the thin queries and their SQL.
"""

"""Operators for preparing text corpora, with their queries and SQL in ``queries``."""

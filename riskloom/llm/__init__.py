"""Operators for preparing text corpora; `queries` registers one query for each."""

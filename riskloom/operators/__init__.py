"""Batch operators, each `DataFrame -> DataFrame` and lazy unless its docstring says otherwise."""

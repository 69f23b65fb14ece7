"""Operators: DataFrame in, DataFrame out, lazy unless a docstring says otherwise."""

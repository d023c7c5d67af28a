"""Operators: DataFrame in, DataFrame out. The clock is always a parameter."""

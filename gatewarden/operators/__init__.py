"""Operators: DataFrame(s) -> DataFrame jobs, grouped by domain."""

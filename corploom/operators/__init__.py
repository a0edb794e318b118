"""Operators over DataFrames: corpus preparation, index building, search, statistics, verification."""

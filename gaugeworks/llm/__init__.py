"""Operators for preparing text corpora: deduplication, extraction, filtering, mixing and tokenization.

Each module holds one operator over DataFrames; ``queries`` binds them to the driver's tables.
Nothing else in the library imports this package.
"""

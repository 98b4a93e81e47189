"""Training-data operators: cleaning, deduplication, scoring, packing and search.

Nothing else in the library imports this package.  Each operator module has a
general interface; ``queries`` derives the fixed result columns from it.
"""

"""Relational operators: the index build and the evaluation of query plans."""

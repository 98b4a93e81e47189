"""The query language and its translation to plan rows."""

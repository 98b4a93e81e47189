"""A full-text search engine on Spark."""

from .readers import read_corpus

__all__ = ["read_corpus"]

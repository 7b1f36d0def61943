"""Versioned, ordered key-value data on Spark."""

from .errors import KeyExistsError, StoreError

__all__ = ["KeyExistsError", "StoreError"]

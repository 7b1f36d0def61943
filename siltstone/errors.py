"""Errors of the store."""


class StoreError(Exception):
    """The store can't do what was asked (closed, read-only, committed twice, damaged)."""


class KeyExistsError(StoreError):
    """An insert met a live key; nothing of its batch was applied."""

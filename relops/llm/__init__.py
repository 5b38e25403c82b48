"""Operators for preparing training text: each by its own method, none used by the rest of the library."""

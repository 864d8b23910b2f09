"""Operators for preparing training text: extraction, archives, deduplication, mixing, tokens.

Nothing outside this subpackage imports it.
"""

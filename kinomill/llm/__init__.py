"""Operators for preparing training data.

Nothing outside this subpackage imports it; it may use the rest of the library.
"""

"""Operators for preparing training text at corpus scale.

Nothing outside this package imports it, so it can be removed without touching the rest of the library.
"""

"""Operators and queries for preparing training text at scale.

Nothing else in the library imports this subpackage; ``__spark_entry__.py``
adds its queries when it is present.
"""

"""Operators that prepare training text: one module each, on public methods.

Nothing else in the library imports this package; ``__spark_entry__`` adds its
queries when it is present.
"""

"""Operators for preparing large text collections as training data.

Nothing outside this package imports it; ``__spark_entry__`` adds its queries only if it can be imported.
"""

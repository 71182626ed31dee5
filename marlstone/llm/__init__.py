"""Operators of a training-data pipeline over document, page and label tables.

Nothing else in the library imports this subpackage.
"""

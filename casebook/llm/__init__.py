"""Operators for building training corpora, one module each.

Nothing else in the library imports this subpackage.  ``registry`` lists the queries.
"""

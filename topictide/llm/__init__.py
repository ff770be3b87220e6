"""Operators for the data of language-model training, one module for each.

Nothing else in the library imports this subpackage. ``queries`` holds the registered
queries and ``ORACLES`` their SQL twins.
"""

"""Operators of a training-data pipeline; nothing outside this package imports it.

Every module holds one operator with its own interface.  ``queries`` binds each of them to the driver's tables.
"""

"""Operators for preparing training text.

Nothing outside this subpackage imports it.  ``registry`` holds the queries and their SQL.
"""

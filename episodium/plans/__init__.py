"""Registered queries: each operator bound to the given tables, with its SQL twin."""

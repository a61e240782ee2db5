"""Operators for preparing training text: one module per operator, queries and pipeline stages beside them."""

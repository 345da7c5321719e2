"""Registered queries: each runs an operator over the given tables; most carry an equivalent SQL text."""

"""Operators bound to concrete tables, with equivalent SQL."""

"""Operators that prepare training data: see the module of each."""

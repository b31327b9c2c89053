"""Operators that prepare training text and samples. Nothing outside this folder imports it."""

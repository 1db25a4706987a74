"""Whole computations put together from the operators."""

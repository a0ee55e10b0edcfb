"""Preparation of training text: ten operators that nothing else in the library imports."""

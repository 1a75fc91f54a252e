"""Operators for preparing language-model training text, each in its own module.

Nothing else in the library imports this subpackage; `queries.py` lists what it registers.
"""

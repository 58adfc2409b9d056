"""Operators for the preparation of language-model training data.

Nothing else in the package imports this one. The registered queries are in
``queries.py``; each operator module has its own general interface.
"""

"""Operators for building training corpora, each a DataFrame-to-DataFrame function.

Nothing outside this folder imports it.
"""

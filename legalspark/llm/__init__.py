"""Operators for preparing text corpora at scale.

Nothing outside this folder imports it; the folder can be removed without
touching the rest of the library.
"""

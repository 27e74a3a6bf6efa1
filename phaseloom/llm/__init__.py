"""Operators for cleaning and preparing text corpora.

Nothing outside this package imports it.
"""

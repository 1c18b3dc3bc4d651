"""Operators over tracks: a DataFrame with key, order and value columns in, the same rows with more columns out.

An operator never collects rows. Ties in the order are the caller's to break, with a unique last order column.
"""

"""Operators for training data: vectors, set and near-duplicate joins, names, languages, tokens, packing and text quality.

Nothing outside this folder imports it.
"""

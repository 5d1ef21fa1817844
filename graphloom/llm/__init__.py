"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it; the entry module adds its queries only when it is present.
"""

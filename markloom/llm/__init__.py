"""Operators for preparing language-model training data at cluster scale.

Nothing outside this subpackage imports it, except the optional hook in
``__spark_entry__.py``.
"""

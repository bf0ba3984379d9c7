"""Operators for large-scale training-data preparation.

Nothing outside this subpackage imports it; ``queries`` and ``sqls`` list what
it registers.
"""

"""Operators for large-scale training data; nothing outside this subpackage imports it."""

"""Operators for preparing training data and linking free text. Nothing outside this subpackage imports it."""

"""Operators for preparing training text at cluster scale. Nothing outside this subpackage imports it."""

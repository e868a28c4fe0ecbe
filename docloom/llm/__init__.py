"""Operators for preparing training text for language models. Nothing outside this subpackage imports it."""

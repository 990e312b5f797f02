"""Operators for preparing language-model training data; nothing else in the package imports this subpackage."""

"""Corpus operators for text training data; nothing else in the package imports this subpackage."""

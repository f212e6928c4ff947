"""Operators for corpora of training data. Nothing outside this subpackage imports it."""

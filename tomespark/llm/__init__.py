"""Operators for corpora of training documents."""

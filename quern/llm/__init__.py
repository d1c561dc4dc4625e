"""Operators for collections of text and code as training data."""

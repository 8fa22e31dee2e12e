"""Operators for training data made of text.  Nothing outside imports this."""

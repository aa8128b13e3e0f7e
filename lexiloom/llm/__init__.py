"""Operators for the text of training data; nothing outside this folder imports them."""

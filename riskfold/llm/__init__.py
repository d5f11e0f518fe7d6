"""Operators of large text-data preparation; nothing else in the library imports them."""

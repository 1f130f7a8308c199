"""Operators for preparing training text, each with its query; nothing else in the library imports them."""

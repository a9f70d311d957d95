"""Operators for preparing language-model data; nothing outside imports them."""

"""Operators for preparing conversation text as training data; nothing outside this package imports it."""

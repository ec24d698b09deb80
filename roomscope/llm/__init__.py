"""Operators for preparing training data from vectors and texts; nothing outside this subpackage imports it."""

"""Operators: normalize, validate, select/cap, upsert, aggregate."""

"""Expressions and patterns that operators share."""

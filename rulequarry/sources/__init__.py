"""Readers: source files, their syntax trees, and rule files."""

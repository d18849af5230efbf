"""Streams of source files: an extension, the original has none."""

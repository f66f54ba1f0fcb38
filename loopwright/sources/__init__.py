"""Readers and parsers of nested input."""

"""Streams of edits."""

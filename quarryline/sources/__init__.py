"""Readers of the library's text formats and writers of its results."""

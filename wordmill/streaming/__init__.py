"""Structured Streaming forms of the word count."""

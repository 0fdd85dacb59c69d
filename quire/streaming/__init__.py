"""Streams of papers."""

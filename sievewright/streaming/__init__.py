"""Streams of inspection records."""

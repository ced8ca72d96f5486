"""Streams of lines."""

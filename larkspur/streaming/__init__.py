"""Streams that keep answers and counts up to date."""

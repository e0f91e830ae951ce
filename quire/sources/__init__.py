"""Readers of files, and the stored index."""

"""Keeping an index current from a stream of files, and windows over calls."""

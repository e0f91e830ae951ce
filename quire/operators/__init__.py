"""Queries over the section table."""

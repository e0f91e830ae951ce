"""Building the section table and what is derived from it."""

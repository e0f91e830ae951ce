"""A document-section index and its queries as Spark DataFrames."""

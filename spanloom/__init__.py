"""spanloom: locate, verify and rewrite spans of text with Spark DataFrames."""

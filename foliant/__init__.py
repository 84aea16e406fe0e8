"""foliant: a provenance-first document-archive analytics engine on Spark DataFrames."""

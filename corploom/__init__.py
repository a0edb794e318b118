"""A full-text retrieval and corpus-analytics engine on Spark DataFrames."""

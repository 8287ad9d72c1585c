"""A corpus ingestion, retrieval and governance engine on Spark DataFrames."""

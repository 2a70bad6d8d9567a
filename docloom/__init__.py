"""A document retrieval and analytics library on Spark DataFrames."""

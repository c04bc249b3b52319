"""Lossless, content-sharing archives of byte and sample streams as Spark DataFrames."""

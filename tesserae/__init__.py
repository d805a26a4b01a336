"""tesserae: content-addressed dedup analytics on Spark DataFrames."""

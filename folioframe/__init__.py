"""folioframe: document-layout analytics on Spark DataFrames."""

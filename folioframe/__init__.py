"""folioframe: document-table analytics on Spark DataFrames."""

"""Evidence reconciliation over document-shaped records, on Spark DataFrames."""

"""plexmer: k-mer feature matrices, feature search and run analysis on Spark DataFrames."""

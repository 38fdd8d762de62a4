"""Build, curate, search and evaluate collections of scientific papers on Spark DataFrames."""

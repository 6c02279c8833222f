"""tidemark: irregular financial and market series, signals and graphs as Spark DataFrames."""

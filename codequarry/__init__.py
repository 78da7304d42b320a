"""codequarry: code-quality analytics as Spark DataFrames."""

"""rowloom: ordered, batch-addressable tables on Spark DataFrames."""

"""branchframe: versioned tables, key-value maps and documents as Spark DataFrames."""

"""stratalens: codebase analytics as Spark DataFrames."""

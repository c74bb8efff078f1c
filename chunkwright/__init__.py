"""Document refinement and chunk analytics on Spark DataFrames."""

"""rhetree: discourse-structure analysis at corpus scale on Spark DataFrames."""

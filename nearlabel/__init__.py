"""nearlabel: similar short texts and label suggestion, on Spark DataFrames."""

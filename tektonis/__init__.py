"""Building-composition and life-cycle analytics on Spark DataFrames."""

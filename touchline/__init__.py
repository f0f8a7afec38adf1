"""Analytics on Spark DataFrames: operators, sources, functions, plans and streams."""

"""Season-results analytics and forecasting on Spark DataFrames."""

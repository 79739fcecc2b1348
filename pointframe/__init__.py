"""pointframe: point-cloud, trajectory and stream analytics on Spark DataFrames."""

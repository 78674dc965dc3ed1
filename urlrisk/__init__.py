"""urlrisk: score tables and streams of URLs with Spark DataFrames."""

"""gridmill: Spark-native analytics for interval-meter time series."""

"""tickloom: Spark-native analytics for market time series."""

"""A Spark-native analytics engine for quantitative time series."""

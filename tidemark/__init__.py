"""A PySpark-native engine for nanosecond time series and large-scale data preparation."""

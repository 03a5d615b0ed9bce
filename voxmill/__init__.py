"""A Spark-native engine for block-wise analysis of n-dimensional arrays and label images."""

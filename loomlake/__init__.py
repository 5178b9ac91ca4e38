"""A Spark-native engine for knowledge retrieval over DataFrames."""

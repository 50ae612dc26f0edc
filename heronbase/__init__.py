"""A Spark-native engine for a cloud-warehouse SQL dialect."""

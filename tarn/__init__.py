"""tarn: a Spark-native engine for logs, metrics and traces."""

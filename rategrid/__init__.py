"""rategrid: a Spark-native engine for marked spatio-temporal event data."""

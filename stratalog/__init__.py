"""stratalog: a Spark-native change journal with time-travel analytics."""

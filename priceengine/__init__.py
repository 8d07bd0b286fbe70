"""A Spark-native price-history and sale-intelligence engine."""

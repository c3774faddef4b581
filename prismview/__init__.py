"""A Spark-native engine for reusing the answers of expensive row predicates."""

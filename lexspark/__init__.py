"""A Spark-native engine for legal-archive search, analytics and reconciliation."""

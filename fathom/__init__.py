"""A Spark-native engine for hybrid document search and corpus enrichment."""

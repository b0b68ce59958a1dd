"""A PySpark-native analytics engine over symbol and knowledge-graph corpora."""

"""A Spark-native engine for dated, snapshot-framed datasets."""

"""Spark-native network extraction and table analytics."""

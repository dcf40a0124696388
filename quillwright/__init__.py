"""A PySpark-native analytics engine for correspondence and event pipelines."""

"""lapwing: a PySpark-native engine for source-code and training-data analytics."""

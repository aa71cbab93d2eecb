"""PySpark-native detection of suspicious behaviour in security event streams."""

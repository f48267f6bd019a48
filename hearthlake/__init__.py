"""hearthlake: a PySpark-native analytics engine for repeatedly observed listing data."""

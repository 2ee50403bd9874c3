"""A PySpark-native engine that aligns a written record with timed speech."""

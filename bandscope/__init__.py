"""A PySpark-native analytics engine for radio-spectrum metadata."""

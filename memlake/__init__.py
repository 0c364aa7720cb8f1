"""memlake: a PySpark-native analytics engine for agent memory."""

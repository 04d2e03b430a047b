"""A PySpark-native analytics engine: declarative plans, one registry of queries."""

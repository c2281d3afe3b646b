"""A PySpark-native analytics engine for competition results and similar fact tables."""

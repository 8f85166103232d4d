"""PySpark-native engine for row-change data: ordering, filtering, compaction, routing, encoding and table comparison."""

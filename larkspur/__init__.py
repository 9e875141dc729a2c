"""larkspur: a Spark-native engine for national address tables: import, street index, search, lookups and overlays."""

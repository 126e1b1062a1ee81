"""wordmill: a PySpark-native text-analytics engine around exact word counting."""

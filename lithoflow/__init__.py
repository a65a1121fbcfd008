"""lithoflow: a PySpark-native engine for ground screening from geological map sheets."""

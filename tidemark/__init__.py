"""A PySpark-native engine for causal, symbolic and relational analytics."""

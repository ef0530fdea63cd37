"""Spark-native telemetry analytics: typed readers, operators, folds and rules as DataFrame functions."""

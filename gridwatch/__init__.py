"""Spark-native analysis, feature engineering and monitoring of regular time-series panels."""

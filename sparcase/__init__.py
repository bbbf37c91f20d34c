"""Spark-native engine for reconciling, classifying and tracking multi-source case documents."""

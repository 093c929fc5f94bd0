"""Orrery: a PySpark-native machine-learning and graph analytics engine."""

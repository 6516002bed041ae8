"""Spark-native correlation of device-activity evidence."""

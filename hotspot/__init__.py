"""Spark-native analytics for satellite thermal-anomaly (hotspot) detections."""

__version__ = "0.1.0"

"""maskwright: a Spark-native engine that finds, scores, replaces and restores personal data in text columns."""

__version__ = "0.1.0"

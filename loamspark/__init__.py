"""loamspark: a Spark-native engine for long-term memory stores."""

__version__ = "0.1.0"

"""tidevec: a Spark-native, log-structured vector analytics engine."""

__version__ = "0.1.0"

"""okrug: a Spark-native analytics engine for territorial and registry data."""

__version__ = "0.1.0"

"""millrace: a PySpark-native analytics engine (DataFrame, SQL and Structured Streaming first)."""

__version__ = "0.1.0"

"""pagewarden: a PySpark-native engine that inspects crawled web content at scale."""

__version__ = "0.1.0"

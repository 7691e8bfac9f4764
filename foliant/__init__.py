"""foliant: a PySpark-native engine for MHTML web archives and the text inside them."""

__version__ = "0.1.0"

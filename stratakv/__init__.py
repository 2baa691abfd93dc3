"""PySpark-native engine for ordered, versioned key-value and wide-column data."""

__version__ = "0.1.0"

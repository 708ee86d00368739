"""A PySpark-native relational analytics engine: a typed SQL dialect, an operator API and a catalog over DataFrames."""

__version__ = "0.1.0"

"""loomlake: a PySpark-native analytics catalog and data-processing engine."""

__version__ = "0.1.0"

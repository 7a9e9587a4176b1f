"""cellgrid: a PySpark-native engine for grid-style evaluation experiments."""

__version__ = "0.1.0"

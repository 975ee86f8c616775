"""plylake: a PySpark-native analytics library for turn-based games at half-move granularity."""

__version__ = "0.1.0"

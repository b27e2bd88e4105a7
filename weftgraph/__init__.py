"""A PySpark-native property-graph and corpus analytics engine."""

__version__ = "0.1.0"

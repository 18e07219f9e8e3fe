"""factloom: a PySpark-native engine for claim/evidence data sets."""

__version__ = "0.1.0"

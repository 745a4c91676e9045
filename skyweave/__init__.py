"""skyweave: a Spark-native analytics engine for spectral survey tables."""

__version__ = "0.1.0"

"""barloom: a Spark-native research engine over daily price bars."""

__version__ = "1.0.0"

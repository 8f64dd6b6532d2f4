"""millrace: a Spark-native engine that turns raw text corpora into training data."""

__version__ = "0.1.0"

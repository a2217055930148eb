"""Spark-native detection and anonymization of personal data."""

__version__ = "0.2.0"

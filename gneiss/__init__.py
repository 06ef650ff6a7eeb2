"""Spark-native engine for multi-source scoring, ranking and data processing.

Every public operator maps DataFrames to DataFrames; nothing here keeps state
outside the session it is given.
"""

__version__ = "0.1.0"

"""riskspark: credit-risk reasoning data operators as Spark DataFrame -> DataFrame functions."""

__version__ = "0.1.0"

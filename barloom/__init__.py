"""barloom: market time-series, news-sentiment and reference-data analytics on PySpark."""

__version__ = "0.1.0"

"""stormframe: Spark DataFrame operators for ordered sensor series."""

__version__ = "0.1.0"

"""fieldframe: gridded fields and ensemble forecasts as Spark tables."""

__version__ = "0.1.0"

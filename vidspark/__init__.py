"""Video-derived analytics on Spark: logo detection and trajectory/action recognition."""

__version__ = "0.1.0"

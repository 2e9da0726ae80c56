"""lowtide: low-frequency audio analytics as ordinary Spark jobs."""

__version__ = "0.1.0"

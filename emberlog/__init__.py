"""emberlog: a log and event analytics engine expressed as PySpark DataFrame transforms."""

__version__ = "0.1.0"

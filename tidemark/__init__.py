"""Product analytics over behaviour events, written as PySpark jobs."""

__version__ = "0.1.0"

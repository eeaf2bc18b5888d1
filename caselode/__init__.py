"""Evidence analytics on Spark: tables, DataFrame operators and a thin case object."""

__version__ = "0.1.0"

"""assayframe: Spark DataFrame operators for designed experiments on long tables."""

__version__ = "0.1.0"

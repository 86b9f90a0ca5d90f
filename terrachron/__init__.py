"""terrachron: dated geographic data and training-corpus processing as Spark jobs."""

__version__ = "0.1.0"

"""quarry: code-intelligence and text kernels as Spark DataFrame programs."""

__version__ = "0.1.0"

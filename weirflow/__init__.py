"""Change data capture on domain models, and the data processing around it, as Spark plans."""

__version__ = "0.1.0"

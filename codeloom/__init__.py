"""codeloom: a source-code relation store and training-data toolkit on Spark."""

__version__ = "0.1.0"

"""quillspark: typed query building and data processing on PySpark DataFrames."""

__version__ = "0.1.0"

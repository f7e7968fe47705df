"""kinweave: genealogical analytics and record-linkage operators on Spark DataFrames."""

__version__ = "0.1.0"

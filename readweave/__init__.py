"""readweave: counting of structured sequencing reads on Spark DataFrames."""

__version__ = "0.1.0"

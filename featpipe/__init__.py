"""featpipe: declarative feature pipelines and model evaluation on Spark DataFrames."""

__version__ = "0.1.0"

"""tunedata: prepare, weight and evaluate fine-tuning data with Spark DataFrames."""

__version__ = "0.1.0"

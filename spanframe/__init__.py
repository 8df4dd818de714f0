"""spanframe: token-labelled text corpora and their curation on Spark DataFrames."""

__version__ = "0.1.0"

"""Session analytics on Spark: transcripts, ledgers, masking, segmentation and state as DataFrames."""

__version__ = "0.1.0"

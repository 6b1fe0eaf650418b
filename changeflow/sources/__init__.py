"""Sources by plugin name: batch and streaming readers as DataFrames."""

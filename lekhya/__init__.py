"""Transcript quality, lexical validation and text-corpus operators on Spark DataFrames."""

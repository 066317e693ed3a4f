"""Threadloom: story-thread analytics over news streams, expressed on Spark DataFrames."""

__version__ = "0.1.0"

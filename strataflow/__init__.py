"""Strataflow: relational, streaming and text-corpus operators expressed on Spark DataFrames."""

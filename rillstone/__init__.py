"""Rillstone: recursive queries and corpus operators, declared on Spark DataFrames."""

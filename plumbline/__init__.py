"""Plumbline: document evaluation, validation and corpus statistics on Spark DataFrames."""

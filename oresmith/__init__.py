"""Layered (bronze / silver / gold) retail tables with data-quality rules, as Spark DataFrames."""

"""Bars, indicators, signals and trade outcomes for many instruments, on Spark DataFrames."""

"""Gridloom: stencil and block-grid analytics on Spark DataFrames."""

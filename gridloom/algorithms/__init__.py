"""Iterative algorithms: state of a bounded size on the driver, one aggregation over the data for each step.

Data come as rows (i0, x): a number and a vector; results as DataFrames, or as
small NumPy arrays where their size does not follow the data.
"""

"""Reductions over streams: an extension, as the arrays themselves are batches."""

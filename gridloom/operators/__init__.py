"""Array operators: each takes arrays and gives a lazy array."""

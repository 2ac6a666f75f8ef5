"""Column expressions: weights, labels, prices, names."""

"""Column expressions: recoding, labels, display text, p-values."""

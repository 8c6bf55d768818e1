"""Column expressions: labels, scores, names, vectors, seeded draws and the position encodings."""

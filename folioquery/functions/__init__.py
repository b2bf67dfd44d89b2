"""Column expressions: text, keys, vectors, validation and retry arithmetic."""

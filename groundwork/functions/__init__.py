"""Column expressions: text folding, hashing, vectors, typed JSON checks."""

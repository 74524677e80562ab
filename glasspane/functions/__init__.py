"""Column expressions: text parsing, vectors, overlap maps."""

"""Column expressions and Arrow functions on text, URLs and time."""

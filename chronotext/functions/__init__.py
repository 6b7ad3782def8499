"""Column functions: text, times, web addresses, vectors. All are built-in expressions."""

"""Column functions: numbers, text and dates."""

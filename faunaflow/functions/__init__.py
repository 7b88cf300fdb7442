"""Column functions and row-wise calculations on tables."""

"""Column expressions over pixel samples, rows of samples, rectangles and flags."""

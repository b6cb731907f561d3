"""Column functions and small driver-side helpers."""

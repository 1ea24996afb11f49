"""Column functions: indicators and formats."""

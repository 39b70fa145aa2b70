"""Column functions and calendar rules."""

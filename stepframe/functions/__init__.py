"""Column functions for process bodies."""

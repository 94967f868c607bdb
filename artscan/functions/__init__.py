"""Column functions and fixed tables of signatures."""

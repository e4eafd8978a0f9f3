"""Column functions: names, splits and geometry."""

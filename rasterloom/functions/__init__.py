"""Column functions: pixels, colours, names and plane geometry."""

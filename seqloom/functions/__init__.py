"""Column functions: sequences and codes, regions and headers, numbers."""

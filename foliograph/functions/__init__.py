"""Column functions: geometry, text, time, formats, keys."""

"""Column functions: they take columns, return columns and never shuffle."""

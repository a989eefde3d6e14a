"""Column functions: text, statistics, addresses."""
